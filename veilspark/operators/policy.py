"""Verdicts on actions: allow < confirm < deny, with reasons."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .detect import detect
from .vault import TOKEN

# Words of buttons that cannot be undone, safe keys, classes the user types alone, harmless actions.
IRREVERSIBLE = (
    r"(?i)(?<![A-Za-z0-9_])(?:submit|pay|payment|place\s*order|confirm|delete|remove|send|transfer|purchase|buy|book|sign\s*(?:up|in)?|register|apply|checkout|proceed|upload|e-?sign|verify)(?![A-Za-z0-9_])"
    "|जमा|भुगतान|पुष्टि|भेजें|हटाएं"
)
SAFE_CHORDS = ("Tab", "Shift+Tab", "Escape", "ArrowUp", "ArrowDown", "ArrowLeft", "ArrowRight", "PageUp", "PageDown", "Home", "End", "Backspace", "Delete", " ", "Control+a", "Meta+a")
USER_TYPES = ("PASSWORD", "OTP", "CARD_CVV")
HARMLESS = ("scroll", "back", "wait", "read_page", "memorize", "ask_user", "done")

_RANK = ("allow", "confirm", "deny")


def decide(*findings: tuple[Column, str, Column | str]) -> Column:
    """``struct<verdict, reasons>`` of (condition, verdict, reason): the worst verdict, the reasons in order."""
    rows = F.array(*[F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(_RANK.index(v)).alias("rank"), (r if isinstance(r, Column) else F.lit(r)).alias("reason"))) for c, v, r in findings])
    met = F.filter(rows, lambda x: x.isNotNull())
    worst = F.coalesce(F.array_max(F.transform(met, lambda x: x["rank"])), F.lit(0))
    return F.struct(F.element_at(F.array(*map(F.lit, _RANK)), worst + 1).alias("verdict"), F.transform(met, lambda x: x["reason"]).alias("reasons"))


def origin_of(url: Column) -> Column:
    """Scheme, host and port of a web URL; null if it has none."""
    m = F.regexp_extract(F.lower(url), r"^(https?://)(?:[^/?#@]*@)?([^/?#]+)", 2)
    scheme = F.regexp_extract(F.lower(url), r"^(https?)://", 1)
    bare = F.regexp_replace(m, F.when(scheme == "https", r":443\z").otherwise(r":80\z"), "")
    return F.when(m != "", F.concat(scheme, F.lit("://"), bare))


def irreversible(name: Column) -> Column:
    return name.rlike(IRREVERSIBLE)


def target_fingerprint(t: Column) -> Column:
    """What identifies a target; compare with ``<=>`` before and after approval."""
    text = lambda c: F.coalesce(c, F.lit(""))
    return F.to_json(F.struct(t["tag"].alias("a"), text(t["role"]).alias("b"), text(t["input_type"]).alias("c"), t["field_class"].alias("d"), t["name"].alias("e"), t["origin"].alias("f"), text(t["href"]).alias("g"), t["editable"].alias("h"), t["occluded"].alias("i"), F.coalesce(t["opaque"], F.lit(False)).alias("j")), {"ignoreNullFields": "false"})


def evaluate(action: Column, target: Column, current_origin: Column, fills: Column | None = None) -> Column:
    """Verdict of an action struct (type, text, url, keys, press_enter) on a target struct.

    ``fills`` for typing: ``array<struct<token, ok, reason>>`` of the text's tokens
    as :func:`vault.fill_decision` judged them; null counts as none.
    """
    none = target.isNull()
    opaque, occluded = F.coalesce(target["opaque"], F.lit(False)), F.coalesce(target["occluded"], F.lit(False))
    hover = F.when(none | opaque, decide((F.lit(True), "deny", "no element at that point"))).otherwise(decide((occluded, "deny", "target is not visible")))
    button = (target["tag"] == "button") | (target["role"] == "button") | (target["input_type"] == "submit")
    link = F.when(target["href"].rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), origin_of(target["href"])).otherwise(current_origin)
    click = F.when(none, decide((F.lit(True), "deny", "no element at that point"))).otherwise(
        decide(
            (opaque, "deny", "target is inside an opaque frame"),
            (occluded, "deny", "target is covered by another element"),
            (target["input_type"] == "file", "confirm", "opens a file upload"),
            (button & irreversible(target["name"]), "confirm", F.concat(F.lit('"'), target["name"], F.lit('" may be irreversible'))),
            (target["href"].isNotNull() & ~link.eqNullSafe(current_origin), "confirm", "link leaves the current site"),
        )
    )
    field = target["field_class"]
    fills = F.coalesce(fills, F.array().cast("array<struct<token:string,ok:boolean,reason:string>>")) if fills is not None else F.array().cast("array<struct<token:string,ok:boolean,reason:string>>")
    bad = F.filter(fills, lambda f: ~f["ok"])
    literal = F.regexp_replace(F.coalesce(action["text"], F.lit("")), TOKEN, "\n")
    kind = action["type"]
    # The detector sees the texts and URLs that its answer counts for, and no others.
    leaked = F.transform(detect(F.when(kind == "type", literal)), lambda s: s["pii_class"])
    released = F.array_join(F.transform(fills, lambda f: f["token"]), ", ")
    stop = (
        F.when(none, "no field at that point").when(opaque, "field is inside an opaque frame").when(occluded, "field is covered by another element")
        .when(~F.coalesce(target["editable"], F.lit(False)), "target is not editable").when(field.isin(*USER_TYPES), F.concat(field, F.lit(" must be entered by the user")))
        .when(F.size(bad) > 0, F.element_at(bad, 1)["reason"])
    )
    typing = F.when(stop.isNotNull(), decide((F.lit(True), "deny", stop))).otherwise(
        decide(
            (F.size(leaked) > 0, "confirm", F.concat(F.lit("text contains untokenized "), F.array_join(F.array_distinct(leaked), ", "))),
            (F.size(fills) > 0, "confirm", F.concat(F.lit("releases "), released, F.lit(" to "), target["origin"])),
            (action["press_enter"], "confirm", "presses Enter, which may submit the form"),
        )
    )
    chord = F.array_join(action["keys"], "+")
    key = F.when(chord == "Enter", decide((F.lit(True), "confirm", "Enter may submit the form"))).otherwise(decide((~chord.isin(*SAFE_CHORDS), "deny", F.concat(F.lit("key "), chord, F.lit(" is not allowed")))))
    url = action["url"]
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    decoded = F.coalesce(F.try_url_decode(url), url)
    stop_url = (
        F.when(url.rlike(TOKEN), "tokens are never substituted into URLs").when(url.isNull() | (scheme == ""), "invalid URL")
        .when(~scheme.isin("http", "https"), F.concat(F.lit("scheme "), scheme, F.lit(": not allowed"))).when(origin_of(url).isNull(), "invalid URL")
        .when(F.size(detect(F.when(kind == "navigate", decoded))) > 0, "the URL contains personal data")
    )
    navigate = F.when(stop_url.isNotNull(), decide((F.lit(True), "deny", stop_url))).otherwise(decide((~origin_of(url).eqNullSafe(current_origin), "confirm", F.concat(F.lit("navigates to "), origin_of(url)))))
    return (
        F.when(kind == "hover", hover).when(kind == "click", click).when(kind == "type", typing).when(kind == "key", key).when(kind == "navigate", navigate)
        .when(kind.isin(*HARMLESS), decide((F.lit(False), "deny", ""))).otherwise(decide((F.lit(True), "deny", "unknown action")))
    )
