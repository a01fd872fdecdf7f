"""Requests, model replies and local planning as Column expressions."""

from __future__ import annotations

import ast
import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .rules import NEVER_RELEASE

# Limits of requests, display grid, image sizes, and key names.
KEEP_FRAMES, URL_LENGTH, OBSERVATION_CHARS, READ_PAGE, SLOTS, PIXEL_CONTROLS = 3, 100, 1000, 6000, 24, 12
DISPLAY, LONGEST_WAIT = 1000, 30.0
FACTOR, LEAST_PIXELS, MOST_PIXELS, RATIO = 32, 3136, 12845056, 200
KEYS = {
    "alt": "Alt", "arrowdown": "ArrowDown", "arrowleft": "ArrowLeft", "arrowright": "ArrowRight", "arrowup": "ArrowUp", "down": "ArrowDown", "left": "ArrowLeft", "right": "ArrowRight",
    "up": "ArrowUp", "backspace": "Backspace", "cmd": "Meta", "ctrl": "Control", "control": "Control", "delete": "Delete", "end": "End", "enter": "Enter", "return": "Enter", "esc": "Escape",
    "escape": "Escape", "home": "Home", "pagedown": "PageDown", "pageup": "PageUp", "shift": "Shift", "space": " ", "tab": "Tab", "meta": "Meta",
}
CLASS_NAMES = {"PERSON": "person name", "EMAIL": "email address", "PHONE": "phone number", "AADHAAR": "Aadhaar number", "PAN": "PAN", "CARD": "card number", "IP_ADDRESS": "IP address"}


def keep_last(steps: DataFrame, key: str, order: str, keep: Column | None = None, frames: int = KEEP_FRAMES) -> DataFrame:
    """``kept``: among the last frames of a task, counting only rows where ``keep`` holds (default: all)."""
    flag = keep if keep is not None else F.lit(True)
    rank = F.sum(flag.cast("int")).over(Window.partitionBy(key).orderBy(F.desc(order)))
    return steps.withColumn("kept", flag & (rank <= frames))


def trimmed_url(url: Column) -> Column:
    u = F.substring_index(url, "?", 1)
    return F.when(F.length(u) > URL_LENGTH, F.concat(F.left(u, F.lit(URL_LENGTH)), F.lit(" ..."))).otherwise(u)


def truncate_middle(text: Column, limit: int = OBSERVATION_CHARS) -> Column:
    half = limit // 2
    cut = F.concat(F.left(text, F.lit(half)), F.lit("\n... [truncated "), (F.length(text) - limit).cast("string"), F.lit(" chars] ...\n"), F.right(text, F.lit(half)))
    return F.when(F.length(text) <= limit, text).otherwise(cut)


def read_page_cut(text: Column, limit: int = READ_PAGE) -> Column:
    """Where a page read ends: the last newline at or before the limit, else the limit."""
    head = F.left(text, F.lit(limit + 1))
    newline = F.length(head) - F.instr(F.reverse(head), "\n")
    found = F.contains(head, F.lit("\n")) & (newline > 0)
    return F.when(F.length(text) <= limit, F.length(text)).when(found, newline).otherwise(F.lit(limit))


def clip_spans(spans: Column, cut: Column) -> Column:
    return F.transform(F.filter(spans, lambda s: s["start"] < cut), lambda s: s.withField("end", F.least(s["end"], cut)))


def key_names(keys: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in KEYS.items() for x in pair])
    return F.transform(keys, lambda k: F.coalesce(F.try_element_at(known, F.lower(k)), k))


def smart_resize(height: Column, width: Column) -> Column:
    """``struct<height, width>``: multiples of 32 within the pixel bounds; null for extreme ratios. Halves round to even."""
    side = lambda x: F.greatest(F.lit(float(FACTOR)), F.bround(x / FACTOR) * FACTOR)
    h, w = side(height.cast("double")), side(width.cast("double"))
    shrink = F.sqrt(height.cast("double") * width / MOST_PIXELS)
    grow = F.sqrt(F.lit(float(LEAST_PIXELS)) / (height.cast("double") * width))
    out = lambda x, plain: F.when(h * w > MOST_PIXELS, F.floor(x / shrink / FACTOR) * FACTOR).when(h * w < LEAST_PIXELS, F.ceil(x * grow / FACTOR) * FACTOR).otherwise(plain).cast("long")
    ok = F.greatest(height, width) / F.least(height, width) <= RATIO
    return F.when(ok, F.struct(out(height, h).alias("height"), out(width, w).alias("width")))


def request_faults(request: Column) -> Column:
    """``array<string>`` of the constraints that a step request breaks."""
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    checks = {
        "task_id": F.length(request["task_id"]).between(1, 64),
        "instruction": F.length(request["instruction"]).between(1, 4000),
        "legend": (size(request["legend"]) <= 256) & F.forall(F.coalesce(request["legend"], F.array().cast("array<struct<token:string,pii_class:string>>")), lambda e: e["token"].rlike(r"^\[[A-Z][A-Z_]*_[0-9]{1,4}\]\z") & e["pii_class"].rlike(r"^[A-Z_]{2,32}\z")),
        "viewport": request["width"].between(1, 8192) & request["height"].between(1, 8192),
        "observations": size(request["observations"]).between(1, 64),
        "assistant_turns": (size(request["assistant_turns"]) <= 63) & (size(request["assistant_turns"]) == size(request["observations"]) - 1),
    }
    return F.filter(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in checks.items()]), lambda x: x.isNotNull())


def allowed_origin(origin: Column, extra: tuple[str, ...] = ()) -> Column:
    """The origin if a server may echo it (an extension, loopback with a port, or a listed one), else null."""
    extension = origin.rlike(r"\Achrome-extension://[a-p]{32}\z")
    loopback = origin.rlike(r"\Ahttp://(127\.0\.0\.1|localhost)(:[0-9]+)?\z")
    port = F.regexp_replace(F.regexp_extract(origin, ":([0-9]+)\\z", 1), "^0+(?=[0-9])", "")
    in_range = (F.regexp_extract(origin, ":[0-9]+\\z", 0) == "") | ((F.length(port) <= 5) & F.coalesce(port.try_cast("int").between(1, 65535), F.lit(False)))
    listed = origin.isin(*extra) if extra else F.lit(False)
    return F.when(~origin.rlike("[\r\n ,]") & (listed | extension | (loopback & in_range)), origin)


_CALL = re.compile(r"<tool_call>\s*(.*?)\s*</tool_call>", re.S)
CALL_SCHEMA = "struct<thoughts:string,arguments:string,error:string>"


def _call(message: str | None) -> tuple:
    m = _CALL.search(message or "")
    if not m:
        return (None, None, "no tool call in the reply")
    try:
        try:
            call = json.loads(m[1])
        except json.JSONDecodeError:
            call = ast.literal_eval(m[1])
        if not isinstance(call, dict) or call.get("name") != "computer_use":
            return (None, None, "tool call is not computer_use")
        args = call.get("arguments")
        args = json.loads(args) if isinstance(args, str) else args
        if not isinstance(args, dict) or "action" not in args:
            return (None, None, "tool call has no action")
        return (message[: m.start()].strip(), json.dumps(args), None)
    except (ValueError, SyntaxError, TypeError, MemoryError, RecursionError):
        return (None, None, "tool call cannot be read")


def parse_tool_call(message: Column) -> Column:
    """``struct<thoughts, arguments, error>`` of a reply: JSON, or a Python literal, in a tool-call block."""

    @F.pandas_udf(CALL_SCHEMA)
    def run(messages: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_call(m) for m in messages], columns=["thoughts", "arguments", "error"])

    return run(message)


_ARGS = "struct<action:string,coordinate:array<double>,text:string,text_value:string,press_enter:boolean,keys:array<string>,pixels:double,url:string,query:string,time:double,duration:double,question:string,fact:string,answer:string>"
SEARCH = "https://www.bing.com/search?q="


def to_action(arguments: Column, width: Column, height: Column) -> Column:
    """``struct<type, x, y, n, dx, dy, text, keys, press_enter, reason>`` of a tool call's JSON arguments."""
    a = F.from_json(arguments, _ARGS)
    x, y = F.get(a["coordinate"], 0), F.get(a["coordinate"], 1)
    inside = (F.size(a["coordinate"]) == 2) & x.between(0, DISPLAY) & y.between(0, DISPLAY)
    kind = a["action"]
    clicks = F.when(kind == "left_click", 1).when(kind == "double_click", 2).when(kind == "triple_click", 3)
    pointed = clicks.isNotNull() | (kind == "mouse_move")
    url = F.coalesce(a["url"], F.lit(""))
    search = lambda q: F.concat(F.lit(SEARCH), F.url_encode(q), F.lit("&FORM=QBLH"))
    goal = F.when(kind == "web_search", search(F.coalesce(a["query"], F.lit("")))).when(url.rlike("^https?://"), url).when(F.contains(url, F.lit(" ")), search(url)).otherwise(F.concat(F.lit("https://"), url))
    type_ = (
        F.when(pointed & ~F.coalesce(inside, F.lit(False)), "unsupported").when(clicks.isNotNull(), "click").when(kind == "mouse_move", "hover").when(kind == "type", "type").when(kind == "key", "key")
        .when(kind.isin("scroll", "hscroll"), "scroll").when(kind.isin("visit_url", "web_search"), "navigate").when(kind == "history_back", "back").when(kind == "wait", "wait")
        .when(kind == "read_page_answer_question", "read_page").when(kind == "pause_and_memorize_fact", "memorize").when(kind == "ask_user_question", "ask_user").when(kind == "terminate", "done")
        .otherwise("unsupported")
    )
    text = F.when(kind == "type", F.coalesce(a["text"], a["text_value"], F.lit(""))).when(type_ == "navigate", goal).when(kind.isin("read_page_answer_question", "ask_user_question"), a["question"]).when(kind == "pause_and_memorize_fact", a["fact"]).when(kind == "terminate", a["answer"])
    pixels = F.coalesce(a["pixels"], F.lit(0.0))
    return F.struct(
        type_.alias("type"), F.when(type_.isin("click", "hover"), x * width / DISPLAY).alias("x"), F.when(type_.isin("click", "hover"), y * height / DISPLAY).alias("y"), F.when(type_ == "click", clicks).alias("n"),
        F.when(kind == "hscroll", -pixels * width / DISPLAY).alias("dx"), F.when(kind == "scroll", -pixels * height / DISPLAY).alias("dy"), text.alias("text"),
        F.when(kind == "key", key_names(a["keys"])).alias("keys"), F.when(kind == "type", F.coalesce(a["press_enter"], F.lit(False))).alias("press_enter"),
        F.when(kind == "wait", F.least(F.coalesce(a["time"], a["duration"], F.lit(3.0)), F.lit(LONGEST_WAIT))).alias("seconds"),
    )


def slot_note(slots: Column) -> Column:
    """The note of the first slots: role, class, state and centre; no values."""
    half_up = lambda c: F.floor(c + 0.5).cast("string")
    parts = F.transform(F.slice(slots, 1, SLOTS), lambda s: F.concat(s["role"], F.lit(" "), s["pii_class"], F.when(s["empty"], " empty ").otherwise(" filled "), half_up(s["x"]), F.lit(","), half_up(s["y"])))
    return F.when(F.size(slots) > 0, F.concat(F.lit("Slots: "), F.array_join(parts, "; "), F.lit("."))).otherwise("")


def parse_slots(note: Column) -> Column:
    """``array<struct<role, pii_class, state, x, y>>`` back from a note."""
    pattern = r"(field|button) ([A-Z_]+) (empty|filled) (-?[0-9]+),(-?[0-9]+)"
    get = lambda i: F.regexp_extract_all(note, F.lit(pattern), F.lit(i))
    rows = F.arrays_zip(get(1).alias("role"), get(2).alias("pii_class"), get(3).alias("state"), get(4).alias("x"), get(5).alias("y"))
    return F.transform(rows, lambda r: F.struct(r["role"].alias("role"), r["pii_class"].alias("pii_class"), r["state"].alias("state"), r["x"].cast("int").alias("x"), r["y"].cast("int").alias("y")))


def wants_submit(instruction: Column) -> Column:
    return instruction.rlike(r"(?i)(?<![A-Za-z0-9_])(?:submit|send|apply)(?![A-Za-z0-9_])")


def plan_local(slots: Column, legend: Column, submit: Column, used: Column, tried: Column, submitted: Column) -> Column:
    """``struct<kind, x, y, token, reason>``: the next step on a page from its slots and the vault's legend."""
    releasable = F.filter(legend, lambda e: ~e["pii_class"].isin(*NEVER_RELEASE))
    free = F.filter(releasable, lambda e: ~F.array_contains(used, e["token"]))
    fields = F.filter(slots, lambda s: (s["role"] == "field") & s["empty"])
    ordered = F.array_sort(F.transform(fields, lambda s, i: F.struct(s["y"].alias("y"), s["x"].alias("x"), i.alias("i"), s["pii_class"].alias("pii_class"))))
    key = lambda s: F.concat(s["pii_class"], F.lit(":"), F.floor(s["x"] + 0.5).cast("string"), F.lit(":"), F.floor(s["y"] + 0.5).cast("string"))
    open_ = F.filter(F.transform(ordered, lambda s: F.struct(s["x"].alias("x"), s["y"].alias("y"), key(s).alias("key"), F.get(F.filter(free, lambda e: e["pii_class"] == s["pii_class"]), 0)["token"].alias("token"))), lambda s: s["token"].isNotNull() & ~F.array_contains(tried, s["key"]))
    first = F.get(open_, 0)
    left = F.size(fields) > 0
    button = F.get(F.filter(slots, lambda s: (s["role"] == "button") & (s["pii_class"] == "SUBMIT")), 0)
    out = lambda kind, x=None, y=None, token=None, reason=None: F.struct(F.lit(kind).alias("kind"), (x if x is not None else F.lit(None)).cast("double").alias("x"), (y if y is not None else F.lit(None)).cast("double").alias("y"), (token if token is not None else F.lit(None)).cast("string").alias("token"), F.lit(reason).cast("string").alias("reason"))
    return (
        F.when(first.isNotNull(), out("fill", first["x"], first["y"], first["token"]))
        .when(submit & ~submitted & ~left & button.isNotNull(), out("submit", button["x"], button["y"]))
        .when(submit & left, out("done", reason="Fill the empty fields, or put the values in the task, then press Start."))
        .when(submit & submitted, out("done", reason="Submitted."))
        .when(F.size(releasable) > 0, out("done", reason="Filled the matching fields."))
        .otherwise(out("done", reason="Nothing on this page needed typing."))
    )


STEP_SCHEMA = "struct<action:string,x:int,y:int,text:string,pii_class:string>"


def scripted_steps(slots: Column, legend: Column, submit: Column, width: Column, height: Column) -> Column:
    """``array`` of the steps of a stand-in model: click and type for every empty field whose class the legend has, top to bottom, then the button.

    Points are on the display grid. Empty where no field can be filled.
    """
    grid = lambda at, side: F.greatest(F.lit(0), F.least(F.lit(DISPLAY), F.bround(at / side * DISPLAY).cast("int")))

    def step(action: str, at: Column | None = None, text: Column | None = None) -> Column:
        x, y = (grid(at["x"], width), grid(at["y"], height)) if at is not None else (F.lit(None), F.lit(None))
        cls = at["pii_class"] if at is not None else F.lit(None)
        return F.struct(F.lit(action).alias("action"), x.cast("int").alias("x"), y.cast("int").alias("y"), (text if text is not None else F.lit(None)).cast("string").alias("text"), cls.cast("string").alias("pii_class"))

    token = lambda s: F.get(F.filter(legend, lambda e: e["pii_class"] == s["pii_class"]), 0)["token"]
    open_ = F.filter(slots, lambda s: (s["role"] == "field") & (s["state"] == "empty") & F.exists(legend, lambda e: e["pii_class"] == s["pii_class"]))
    placed = F.array_sort(F.transform(open_, lambda s, i: F.struct(s["y"].alias("y"), s["x"].alias("x"), i.alias("i"), s["pii_class"].alias("pii_class"), token(s).alias("token"))))
    typed = F.flatten(F.transform(placed, lambda s: F.array(step("left_click", s), step("type", s, s["token"]))))
    buttons = F.slice(F.filter(slots, lambda s: (s["role"] == "button") & (s["pii_class"] == "SUBMIT")), 1, 1)
    pressed = F.when(submit, F.transform(buttons, lambda s: step("left_click", s))).otherwise(F.array().cast(f"array<{STEP_SCHEMA}>"))
    return F.when(F.size(open_) > 0, F.concat(typed, pressed, F.array(step("terminate")))).otherwise(F.array().cast(f"array<{STEP_SCHEMA}>"))


def scripted_reply(steps: Column, turns: Column) -> Column:
    """The step after so many model turns; the last one from then on."""
    return F.get(steps, F.least(turns, F.size(steps) - 1))


def privacy_note(legend: Column) -> Column:
    """What a task text says about placeholders: a fixed sentence and the legend in order."""
    known = F.create_map(*[F.lit(x) for kv in CLASS_NAMES.items() for x in kv])
    name = lambda c: F.coalesce(F.try_element_at(known, c), F.lower(F.translate(c, "_", " ")))
    listed = F.array_join(F.transform(legend, lambda e: F.concat(e["token"], F.lit(" ("), name(e["pii_class"]), F.lit(")"))), ", ")
    return F.concat(F.lit(PLACEHOLDERS), F.when(F.size(legend) > 0, F.concat(F.lit("\nPlaceholders in use: "), listed, F.lit("."))).otherwise(""))


#: Own wording of the note on placeholders.
PLACEHOLDERS = "Privacy note: values such as [EMAIL_1] are placeholders for real ones. Type a placeholder as shown to enter its value. Dark boxes hide content that is not shared."


def observation_texts(steps: DataFrame, key: str, order: str, cue: str = "Here is the next screenshot.") -> DataFrame:
    """The text of each step's message and whether its image stays (the last three that have one do).

    ``steps``: key, order, instruction, url, text_observation, user_response,
    has_image. The first step shows the task; a reply of the user goes before a
    note, a note before the cue alone. Without its image a step without either is
    dropped.
    """
    kept = keep_last(steps, key, order, F.col("has_image"))
    first = F.row_number().over(Window.partitionBy(key).orderBy(order)) == 1
    prefix = F.when(F.coalesce(F.length("url"), F.lit(0)) > 0, F.concat(F.lit("Current URL: "), trimmed_url(F.col("url")), F.lit("\n"))).otherwise("")
    has = lambda c: F.coalesce(F.length(c), F.lit(0)) > 0
    note = F.concat(prefix, truncate_middle(F.col("text_observation")))
    text = (
        F.when(F.col("_first"), F.col("instruction")).when(has("user_response"), F.concat(prefix, "user_response"))
        .when(has("text_observation") & F.col("kept"), F.concat(note, F.lit("\n" + cue))).when(has("text_observation"), note).when(F.col("kept"), F.concat(prefix, F.lit(cue)))
    )
    return kept.withColumn("_first", first).select(key, order, text.alias("text"), F.col("kept").alias("image")).where("text IS NOT NULL")
