"""Web pages as tables: text with segments, form fields, buttons, media, labelled values, generated text, ground truth.

One pass of the standard HTML parser per page in an Arrow stage. Lines break at
blocks and ``br`` (painted geometry is not available in stored pages). Labels of
shown values are classified there by the same keywords as fields, each distinct
label once a worker.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from html.parser import HTMLParser
from itertools import takewhile

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from ..operators.detect import detect
from ..operators.fields import classify, label_class
from .elements import CLOSED_BY, CONTROLS, SCOPES, Element, control_label, generated_rules, generated_text, text_of, value_candidates
from .synth import let

# Elements whose text is not page text, void elements, blocks, input types without text, and the least media side.
SKIP = frozenset("script style noscript template textarea option select head title".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BLOCK = frozenset("address article aside blockquote body dd div dl dt fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section table td th tr ul".split())
NOT_TEXT = frozenset("hidden submit button reset image checkbox radio range color".split())
SUBMIT = r"(?i)submit|send|apply|save"
LEAST_MEDIA = 24
SOLID, CHOSEN, NOT_SHOWN = ("PASSWORD", "OTP", "CARD_CVV"), ("DOB", "ADDRESS", "PINCODE"), ("PASSWORD",)
TOKEN = r"\[[A-Z][A-Z_]*_[0-9]+\]"
LABEL_RULE, LABEL_SCORE = 40, 0.75

_SCHEMA = (
    "text string, context string, segments array<struct<start:int,length:int>>, fields array<struct<tag:string,type:string,autocomplete:string,name:string,id:string,label:string,placeholder:string,aria_label:string,value:string,options:array<string>>>, "
    "buttons array<string>, media array<struct<tag:string,w:double,h:double>>, opaque array<struct<tag:string,source:string>>, generated array<string>, "
    "labelled array<struct<segment:int,step:int,element:int,pii_class:string>>, truth array<struct<pii_class:string,value:string>>"
)
#: Pages whose results an Arrow stage holds at once.
SLICE = 64
_VALUE = re.compile("[0-9@]")
_STYLE_SIDE = re.compile(r"(?:^|;)\s*(width|height)\s*:\s*([0-9.]+)px", re.I)


def _split(schema: str) -> Iterator[str]:
    depth, start = 0, 0
    for i, c in enumerate(schema):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            yield schema[start:i].strip()
            start = i + 1
    yield schema[start:].strip()


def _side(attrs: dict, name: str) -> float:
    """A side in pixels from the attribute or the inline style; stored pages know no other geometry."""
    raw = attrs.get(name, "").strip().removesuffix("px")
    if raw.replace(".", "", 1).isdigit():
        return float(raw)
    sides = {k.lower(): v for k, v in _STYLE_SIDE.findall(attrs.get("style", ""))}
    value = sides.get(name, "0")
    return float(value) if value.replace(".", "", 1).isdigit() else 0.0


class _Page(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Element("", {}, None, 0)
        self.stack: list[Element] = []
        self.elements: list[Element] = []
        self.open: dict[str, list[int]] = {}
        self.blocks: list[int] = []
        self.by_id: dict[str, Element] = {}
        self.owners: list[Element] = []
        self.opaque: list[tuple] = []
        self.css: list[str] = []
        self.parts: list[str] = []
        self.length = 0
        self.segments: list[tuple[int, int]] = []
        self.fields: list[dict] = []
        self.buttons: list[str] = []
        self.media: list[tuple] = []
        self.truth: list[list] = []
        self.truth_depth: list[int] = []
        self.context: list[str] = []
        self.labels: dict[str, str] = {}
        self.label: list | None = None
        self.button: list | None = None
        self.area: list | None = None
        self.gap = ""

    def _open(self, tag: str, attrs: dict) -> Element:
        if closed := CLOSED_BY.get(tag):
            scope = max((self.open[t][-1] for t in SCOPES if self.open.get(t)), default=-1)
            outer = [places[bisect_right(places, scope)] for t in closed if (places := self.open.get(t)) and places[-1] > scope]
            if outer:
                self._close(min(outer))
        if tag == "tr" and self.stack and self.stack[-1].tag == "table":
            self._push(self._open("tbody", {}))
        if tag in BLOCK and self.blocks and self.stack[self.blocks[-1]].tag == "p":
            self._close(self.blocks[-1])
        e = Element(tag, attrs, self.stack[-1] if self.stack else self.root, len(self.elements))
        e.hidden = e.hidden or tag in SKIP
        self.elements.append(e)
        if attrs.get("id"):
            self.by_id.setdefault(attrs["id"], e)
        # What stands below an element also stands below those around it, so the walks up end early.
        if tag in CONTROLS:
            for a in takewhile(lambda x: x.controls < 2, e.ancestors()):
                a.controls += 1
        elif tag == "button":
            for a in takewhile(lambda x: not x.has_button, e.ancestors()):
                a.has_button = True
        elif tag == "tr":
            for a in takewhile(lambda x: x.first_row is None, (x for x in e.ancestors() if x.tag == "table")):
                a.first_row = e
        return e

    def _push(self, e: Element) -> None:
        """Open elements are also known by tag, and blocks by their depth, so no tag has to search the stack."""
        self.open.setdefault(e.tag, []).append(len(self.stack))
        if e.tag in BLOCK:
            self.blocks.append(len(self.stack))
        self.stack.append(e)

    def _close(self, depth: int) -> None:
        for e in self.stack[depth:]:
            self.open[e.tag].pop()
        del self.stack[depth:]
        while self.blocks and self.blocks[-1] >= depth:
            self.blocks.pop()
        while self.truth_depth and self.truth_depth[-1] > len(self.stack):
            self.truth_depth.pop()

    def _put(self, text: str) -> None:
        self.parts.append(text)
        self.length += len(text)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        a = {k: v or "" for k, v in attrs}
        e = self._open(tag, a)
        if tag in BLOCK or tag == "br":
            self.gap = "\n"
        if tag == "label":
            self.label = [a.get("for", ""), ""]
        elif tag == "button":
            self.button = [a.get("aria-label", ""), ""]
        elif tag == "option" and self.fields and self.fields[-1]["tag"] == "select":
            self.fields[-1]["chosen"].append(("selected" in a, e))
        if tag in CONTROLS:
            kind = a.get("type", "text" if tag == "input" else tag).lower()
            if kind == "submit":
                self.buttons.append(a.get("value", "") or "submit")
            if kind not in NOT_TEXT:
                inside = self.label[1].strip() if self.label else ""
                self.fields.append({"tag": tag, "type": a.get("type"), "autocomplete": a.get("autocomplete"), "name": a.get("name"), "id": a.get("id"), "label": inside or None, "placeholder": a.get("placeholder"), "aria_label": a.get("aria-label"), "value": a.get("value", ""), "element": e, "chosen": []})
                if tag == "textarea":
                    self.area = []
        w, h = (_side(a, "width"), _side(a, "height")) if tag in ("img", "image", "video", "canvas") or "url(" in a.get("style", "") else (0.0, 0.0)
        if w >= LEAST_MEDIA and h >= LEAST_MEDIA:
            self.media.append((tag, w, h))
        if tag in ("iframe", "frame", "embed", "object"):
            self.opaque.append((tag, a.get("src") or a.get("data") or ""))
        if tag not in VOID:
            self._push(e)
            if "data-gt" in a:
                self.truth.append([a["data-gt"], ""])
                self.truth_depth.append(len(self.stack))

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCK:
            self.gap = "\n"
        if tag == "label" and self.label:
            if self.label[0]:
                self.labels[self.label[0]] = self.label[1].strip()
            self.label = None
        elif tag == "button" and self.button:
            self.buttons.append((self.button[0] or self.button[1]).strip())
            self.button = None
        elif tag == "textarea" and self.area is not None:
            self.fields[-1]["value"] = "".join(self.area)
            self.area = None
        if self.open.get(tag):
            self._close(self.open[tag][-1])

    def handle_data(self, data: str) -> None:
        if self.label:
            self.label[1] += data
        if self.button:
            self.button[1] += data
        if self.area is not None:
            self.area.append(data)
        at = self.stack[-1] if self.stack else self.root
        at.kids.append(data)
        if at.tag == "style":
            self.css.append(data)
        if at.hidden:
            return
        if not data.strip():
            self.gap = self.gap or (" " if data else "")
            return
        if self.parts:
            last = self.parts[-1]
            self._put(" " if self.gap == "\n" and last.rstrip().endswith(":") else self.gap)
        self.gap = ""
        text = " ".join(data.split())
        lead = " " if data[0].isspace() and self.parts and not self.parts[-1].endswith((" ", "\n")) else ""
        self._put(lead)
        self.segments.append((self.length, len(text)))
        self.owners.append(at)
        self._put(text)
        if data[-1].isspace():
            self.gap = " "
        if self.truth_depth:
            self.truth[-1][1] += text
        else:
            self.context.append(text)

    def _labelled_by(self, ids: str) -> str:
        return " ".join(text_of(self.by_id[i]) for i in ids.split() if i in self.by_id).strip()

    def _field(self, f: dict) -> dict:
        e, chosen = f.pop("element"), f.pop("chosen")
        f["label"] = self._labelled_by(e.attrs.get("aria-labelledby", "")) or f["label"] or self.labels.get(f["id"] or "") or control_label(e) or None
        f["options"] = []
        if chosen:
            f["value"] = text_of(next((o for on, o in chosen if on), chosen[0][1]))
            if "multiple" in e.attrs or e.attrs.get("size", "1").strip() not in ("", "0", "1"):
                f["options"] = [text_of(o) for _, o in chosen]
        return f

    def _generated(self) -> list[str]:
        rules = generated_rules("\n".join(self.css)) if self.css else {}
        return [t for t in (generated_text(e, rules) for e in self.elements if e.tag not in ("html", "body") and not e.hidden) if t] if rules else []

    def _labelled(self) -> list[tuple]:
        labelled = []
        for i, owner in enumerate(self.owners):
            for step, element, label, own in value_candidates(owner):
                cls = label_class(label)
                # What has a class itself is a label, unless it looks like a value.
                if cls and cls not in NOT_SHOWN and (_VALUE.search(own) or label_class(own) is None):
                    labelled.append((i, step, element, cls))
        return labelled

    def row(self, names: list[str]) -> tuple:
        made = {
            "text": lambda: "".join(self.parts), "context": lambda: "\n".join(self.context), "segments": lambda: self.segments, "fields": lambda: [self._field(f) for f in self.fields], "buttons": lambda: self.buttons,
            "media": lambda: self.media, "opaque": lambda: self.opaque, "generated": self._generated, "labelled": self._labelled, "truth": lambda: [tuple(t) for t in self.truth],
        }
        return tuple(made[n]() for n in names)

    def forget(self) -> None:
        """Elements point at each other; a page that is done leaves nothing to the collector of cycles."""
        for e in (self.root, *self.elements):
            e.kids, e.cells, e.parent, e.prev, e.first_row = [], [], None, None, None


NAMES = [x.split()[0] for x in _split(_SCHEMA)]


def _scan(html: str | None, names: list[str] = NAMES) -> tuple:
    page = _Page()
    if html:
        page.feed(html)
        page.close()
    row = page.row(names)
    page.forget()
    return row


def scan(pages: DataFrame, html: str = "html", only: tuple[str, ...] | None = None) -> DataFrame:
    """The pages (all other columns) with text, context, segments, fields, buttons, media, opaque frames, generated text, label candidates and truth, or ``only`` some of these.

    Results leave the stage in slices, so a worker holds an input batch (which Spark bounds in rows and bytes) and few pages beside it.
    """
    kept = [x for x in _split(_SCHEMA) if only is None or x.split()[0] in only]
    names = [x.split()[0] for x in kept]
    kind = to_arrow_type(StructType.fromDDL(", ".join(kept)))

    @F.arrow_udf("struct<" + ", ".join(x.replace(" ", ":", 1) for x in kept) + ">")
    def run(htmls: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in htmls:
            for at in range(0, len(batch), SLICE):
                yield pa.array([_scan(h.as_py(), names) for h in batch.slice(at, SLICE)], kind)

    rest = [c for c in pages.columns if c != html]
    return pages.withColumn("_page", run(F.col(html))).select(*rest, "_page.*")


def _exploded(scanned: DataFrame, key: str, column: str, name: str) -> DataFrame:
    """One row per entry of a scanned column.

    The outer generator keeps Catalyst from inferring a filter on the array, which would
    scan every page a second time, below any repartitioning.
    """
    return scanned.select(key, F.posexplode_outer(column).alias("ordinal", name)).where(F.col(name).isNotNull())


def field_rows(scanned: DataFrame, key: str) -> DataFrame:
    """One row per form control with its class and whether it is filled."""
    each = _exploded(scanned, key, "fields", "f")
    kind = classify(F.col("f.type"), F.col("f.autocomplete"), label=F.col("f.label"), aria_label=F.col("f.aria_label"), placeholder=F.col("f.placeholder"), name=F.col("f.name"), id=F.col("f.id"))
    return each.withColumn("c", kind).select(key, "ordinal", "f.tag", "f.type", "f.label", "c.pii_class", "c.source", (F.coalesce(F.length("f.value"), F.lit(0)) == 0).alias("empty"))


def labelled_values(segments: Column, labelled: Column) -> Column:
    """``array`` of spans of shown values that a term, header or short text before them names.

    Each text takes the nearest of three elements whose label has a class (not of
    passwords) and which is not a label itself; the texts of an element make one
    span. All within the row: two sorts, no shuffle and no second parse.
    """
    named = F.transform(labelled, lambda c: F.struct(c["element"].alias("element"), c["segment"].alias("segment"), c["pii_class"].alias("pii_class"), segments[c["segment"]]["start"].alias("start"), segments[c["segment"]]["length"].alias("length")))
    nearest = let(named, lambda n: F.filter(n, lambda c, i: (i == 0) | (F.get(n, i - 1)["segment"] != c["segment"])))
    grouped = F.array_sort(nearest)
    differs = lambda n, c, j: F.coalesce(F.get(n, j)["element"] != c["element"], F.lit(True))
    span = lambda a, z: F.struct(a["start"].alias("start"), (z["start"] + z["length"]).alias("end"), a["pii_class"].alias("pii_class"), F.lit(LABEL_SCORE).alias("score"), F.concat(F.lit("label."), a["pii_class"]).alias("rule"), F.lit(LABEL_RULE).alias("rule_idx"))
    return let(grouped, lambda n: F.zip_with(F.filter(n, lambda c, i: differs(n, c, i - 1)), F.filter(n, lambda c, i: differs(n, c, i + 1)), span))


def label_spans(scanned: DataFrame, key: str) -> DataFrame:
    """One row per labelled value: key and the span's fields."""
    found = scanned.select(key, labelled_values(F.col("segments"), F.col("labelled")).alias("_spans"))
    return _exploded(found, key, "_spans", "s").select(key, "s.*")


def page_spans(scanned: DataFrame, key: str) -> DataFrame:
    """One row per page: text and its spans, labelled values included, after overlap resolution.

    The generator of one row keeps the two Arrow stages apart: Spark 4.1 leaves the
    second one unplanned where both fall into one projection.
    """
    both = F.struct("text", labelled_values(F.col("segments"), F.col("labelled")).alias("_extra"))
    extra = scanned.select(key, F.inline(F.array(both)))
    return extra.select(key, "text", detect(F.col("text"), extra=F.col("_extra")).alias("spans"))


def generated_findings(scanned: DataFrame, key: str) -> DataFrame:
    """Elements whose generated text has a hit or a forged token; the first hit masks the whole element."""
    each = _exploded(scanned, key, "generated", "text").withColumn("hit", F.try_element_at(detect(F.col("text")), F.lit(1)))
    out = each.select(key, "ordinal", F.col("hit.pii_class").alias("pii_class"), F.trim("text").alias("value"), F.lit("solid").alias("kind"), F.concat(F.lit("pseudo."), F.col("hit.rule")).alias("rule"), F.col("text").rlike(TOKEN).alias("forged"))
    return out.where("rule IS NOT NULL OR forged")


def field_findings(scanned: DataFrame, key: str) -> DataFrame:
    """What form controls give away: one row per control, or per option of a list box, with class, value, kind, source and rule.

    Secret classes are masked whole; a class of the field decides before the text
    does; placeholders count only where the value is empty.
    """
    f = F.col("f")
    each = _exploded(scanned, key, "fields", "f").where(F.lower(F.coalesce(f["type"], F.lit(""))) != "file")
    kind = classify(f["type"], f["autocomplete"], label=f["label"], aria_label=f["aria_label"], placeholder=f["placeholder"], name=f["name"], id=f["id"])["pii_class"]
    boxed = F.size(f["options"]) > 0
    texts = F.when(boxed, f["options"]).when(F.length(f["value"]) > 0, F.array(f["value"])).otherwise(F.array(f["placeholder"]))
    each = each.withColumn("k", kind).select(key, "ordinal", "f", "k", F.posexplode(texts).alias("item", "value")).where(F.length("value") > 0)
    k, typed = F.col("k"), F.length(f["value"]) > 0
    secret = ~boxed & typed & ((F.lower(F.coalesce(f["type"], F.lit(""))) == "password") | F.coalesce(k.isin(*SOLID), F.lit(False)))
    semantic = ~boxed & typed & k.isNotNull() & ((f["tag"] != "select") | k.isin(*CHOSEN))
    # The detector sees the values that no field decides.
    each = each.withColumn("hit", F.try_element_at(detect(F.when(secret | semantic, None).otherwise(F.col("value"))), F.lit(1)))
    rule = F.when(secret, "field.secret").when(semantic, "field.semantic").otherwise(F.concat(F.when(boxed, "option.").when(typed, "field.").otherwise("placeholder."), F.col("hit.rule")))
    cls = F.when(secret, F.coalesce(k, F.lit("PASSWORD"))).when(semantic, k).otherwise(F.col("hit.pii_class"))
    source = F.when(boxed | typed, "field").otherwise("placeholder")
    out = each.select(key, "ordinal", "item", cls.alias("pii_class"), "value", F.when(secret, "solid").otherwise("token").alias("kind"), source.alias("source"), rule.alias("rule"))
    return out.where("rule IS NOT NULL")


def submit_buttons(scanned: DataFrame, key: str) -> DataFrame:
    return _exploded(scanned, key, "buttons", "name").select(key, "name").where(F.col("name").rlike(SUBMIT))


def opaque_frames(scanned: DataFrame, key: str) -> DataFrame:
    """Frames and plugins whose content is not in the page, one row each."""
    return _exploded(scanned, key, "opaque", "o").select(key, "o.tag", "o.source")


#: Characters of a bin of a page's text; intervals meet in the bins that they share.
BIN = 1024


def _binned(rows: DataFrame, start: str, end: str, name: str) -> DataFrame:
    low, high = F.floor(F.col(start) / BIN), F.floor(F.greatest(F.col(start), F.col(end) - 1) / BIN)
    return rows.withColumn(name, F.explode(F.sequence(low, high)))


def locate_spans(spans: DataFrame, segments: DataFrame, key: str) -> DataFrame:
    """Pieces of spans (key, ordinal, start, end) in text segments (key, segment, start, length).

    An interval join: both sides are dealt to the bins of a page that they reach into, and a pair is
    reported in the bin where its common part begins. So the segments of a large page are spread, and a span meets only those nearby.
    """
    seg = segments.select(F.col(key).alias("_key"), "segment", F.col("start").alias("seg_start"), (F.col("start") + F.col("length")).alias("seg_end"))
    left, right = _binned(spans, "start", "end", "_bin"), _binned(seg, "seg_start", "seg_end", "_seg_bin")
    meet = (F.col("seg_start") < F.col("end")) & (F.col("seg_end") > F.col("start")) & (F.floor(F.greatest("start", "seg_start") / BIN) == F.col("_bin"))
    joined = left.join(right, (F.col(key) == F.col("_key")) & (F.col("_bin") == F.col("_seg_bin")) & meet)
    return joined.select(key, "ordinal", "segment", (F.greatest("start", "seg_start") - F.col("seg_start")).alias("from"), (F.least("end", "seg_end") - F.col("seg_start")).alias("to"))
