"""Readers and writers of the record formats: COCO annotations, manifests, requests, images."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.protocol import request_faults

IMAGE_BYTES = 4 * 1024 * 1024
# Mean and deviation of pixel channels where the metadata gives none.
MEAN, STD = (0.485, 0.456, 0.406), (0.229, 0.224, 0.225)
_COCO = (
    "images array<struct<id:long,file_name:string,width:long,height:long>>, annotations array<struct<id:long,image_id:long,category_id:long,bbox:array<double>,area:double,iscrowd:int>>, "
    "categories array<struct<id:long,name:string>>"
)


def read_coco(spark: SparkSession, path: str) -> DataFrame:
    """One row per annotation: image_id, file_name, width, height, pii_class, x, y, w, h. A folder may hold several COCO files with the same categories."""
    raw = spark.read.schema(_COCO).json(path, multiLine=True)
    images = raw.select(F.explode("images").alias("i")).select("i.*")
    kinds = raw.select(F.explode("categories").alias("c")).select(F.col("c.id").alias("category_id"), F.col("c.name").alias("pii_class")).distinct()
    boxes = raw.select(F.explode("annotations").alias("a")).select("a.image_id", "a.category_id", *[F.col("a.bbox")[i].alias(n) for i, n in enumerate("xywh")])
    # Categories are few and each has many boxes: by a shuffle all boxes of one would go to one task.
    return boxes.join(F.broadcast(kinds), "category_id").join(images.withColumnRenamed("id", "image_id"), "image_id").select("image_id", "file_name", "width", "height", "pii_class", "x", "y", "w", "h")


def write_coco(boxes: DataFrame, path: str, classes: list[str], images_per_file: int = 5_000) -> None:
    """Annotation rows as COCO files, each with the images and annotations of about ``images_per_file`` images, and all categories.

    A file is one COCO document, so any reader of the format takes it; the number of
    files grows with the images.
    """
    n = boxes.select("image_id").distinct().count()
    files = max(1, -(-n // images_per_file))
    known = F.create_map(*[F.lit(x) for i, c in enumerate(classes, 1) for x in (c, i)])
    shard = F.pmod(F.xxhash64("image_id"), F.lit(files)).cast("int")
    box = F.array(*[F.round(F.col(c), 1) for c in "xywh"])
    one = F.struct("image_id", known[F.col("pii_class")].cast("long").alias("category_id"), box.alias("bbox"), F.round(F.col("w") * F.col("h"), 1).alias("area"), F.lit(0).alias("iscrowd"))
    image = F.struct(F.col("image_id").alias("id"), "file_name", "width", "height")
    # A task reads the boxes of one file, whatever their number in all.
    dealt = boxes.select(shard.alias("shard"), "image_id", "file_name", "width", "height", "pii_class", *"xywh").repartitionById(files, F.col("shard"))
    each = dealt.groupBy("shard").agg(F.array_sort(F.collect_set(image)).alias("images"), F.array_sort(F.collect_list(one)).alias("a"))
    numbered = F.transform("a", lambda a, i: F.struct((F.col("shard").cast("long") * (1 << 32) + i).alias("id"), a["image_id"].alias("image_id"), a["category_id"].alias("category_id"), a["bbox"].alias("bbox"), a["area"].alias("area"), a["iscrowd"].alias("iscrowd")))
    names = F.array(*[F.struct(F.lit(i).cast("long").alias("id"), F.lit(c).alias("name")) for i, c in enumerate(classes, 1)])
    document = F.to_json(F.struct("images", numbered.alias("annotations"), names.alias("categories")))
    each.select(document.alias("value")).write.text(path)


def read_model_meta(spark: SparkSession, path: str) -> dict:
    """A vision model's metadata file (one small row): resolution, classes by logit index (null: unused), thresholds by class, mean, std, stretch."""
    schema = "resolution int, classes array<string>, thresholds map<string,double>, mean array<double>, std array<double>, stretch boolean"
    row = spark.read.schema(schema).json(path, multiLine=True).first().asDict()
    return row | {"thresholds": row["thresholds"] or {}, "mean": row["mean"] or list(MEAN), "std": row["std"] or list(STD), "stretch": bool(row["stretch"])}


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.schema("seed long, pages array<struct<file:string,template:string,tags:array<string>>>").json(path, multiLine=True)
    return raw.select("seed", F.explode("pages").alias("p")).select("seed", "p.*")


def read_dumps(spark: SparkSession, folder: str) -> DataFrame:
    """Page dumps: an index of pages joined with their images' bytes by file name; a page without an image keeps null."""
    index = spark.read.schema("id string, url string, template string, image string").json(f"{folder}/index.json", multiLine=True)
    images = spark.read.format("binaryFile").option("pathGlobFilter", "*.png").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("_name"), F.col("content").alias("png"))
    return index.join(images, F.coalesce("image", F.concat("id", F.lit(".png"))) == F.col("_name"), "left").drop("_name")


_STEP = (
    "task_id string, instruction string, legend array<struct<token:string,cls:string>>, viewport struct<width:int,height:int>, "
    "observations array<struct<screenshot:string,url:string,text_observation:string,user_response:string>>, assistant_turns array<string>"
)


def step_requests(lines: DataFrame, body: str = "value") -> DataFrame:
    """A (streaming) table of JSON step requests, parsed to ``request``, with ``faults``: ``json`` alone if it can't be read."""
    raw = F.from_json(F.col(body), _STEP)
    shaped = F.struct(
        raw["task_id"].alias("task_id"), raw["instruction"].alias("instruction"), F.transform(raw["legend"], lambda e: F.struct(e["token"].alias("token"), e["cls"].alias("pii_class"))).alias("legend"),
        raw["viewport"]["width"].alias("width"), raw["viewport"]["height"].alias("height"), raw["observations"].alias("observations"), raw["assistant_turns"].alias("assistant_turns"),
    )
    out = lines.withColumn("request", F.when(F.try_parse_json(F.col(body)).isNotNull(), shaped))
    return out.withColumn("faults", F.when(F.col("request").isNull(), F.array(F.lit("json"))).otherwise(request_faults(F.col("request"))))


def request_stream(spark: SparkSession, path: str) -> DataFrame:
    """Requests of a folder of JSON lines as they arrive."""
    return step_requests(spark.readStream.text(path))


def request_body(step: Column) -> Column:
    return F.to_json(step)


def body_digest(body: Column) -> Column:
    return F.sha2(body, 256)


def screenshot_fault(b64: Column) -> Column:
    """Why a base64 screenshot is refused (null: it is not): unreadable, too large, or of another format."""
    raw = F.try_to_binary(b64, F.lit("base64"))
    head = F.hex(F.substring(raw, 1, 12))
    known = head.startswith("89504E47") | head.startswith("FFD8FF") | (head.startswith("52494646") & head.endswith("57454250"))
    return F.when(raw.isNull(), "422").when(F.octet_length(raw) > IMAGE_BYTES, "413").when(~known, "415")
