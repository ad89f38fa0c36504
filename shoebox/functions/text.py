"""Text functions that Spark lacks, vectorised over Arrow batches, and lenient reading of model output."""

from __future__ import annotations

import json
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def nfkc(text: Column) -> Column:
    """Compatibility composition of each text; nulls stay."""
    return F.pandas_udf(_composed, "string")(text)


def _composed(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


def nfkc_all(texts: Column) -> Column:
    """Compatibility composition of each text of an array; nulls stay."""
    return F.pandas_udf(_all_composed, "array<string>")(texts)


def _all_composed(lists: pd.Series) -> pd.Series:
    return lists.map(lambda x: [None if t is None else unicodedata.normalize("NFKC", t) for t in x], na_action="ignore")


def stripped(text: Column) -> Column:
    """A text without the white space around it."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


#: Columns that a model's answer is read into.
ANSWER = "caption string, ocr_text string, scene_tags array<string>, object_tags array<string>, people_count int, confidence double"
_NAMES = {"description": "caption", "text": "ocr_text", "scenes": "scene_tags", "objects": "object_tags", "people": "people_count", "score": "confidence"}
_LISTS = ("scene_tags", "object_tags")


def _strict(text: Column) -> Column:
    """An answer that is JSON as it stands or inside code fences, or null."""
    inner = F.regexp_extract(text, r"(?s)```(?:json)?\s*(\{.*\})\s*```", 1)
    outer = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    tries = [F.from_json(x, f"struct<{_ddl()}>", {"mode": "PERMISSIVE"}) for x in (text, inner, outer)]
    return F.coalesce(*(F.when(t["caption"].isNotNull(), t) for t in tries))


def _ddl() -> str:
    return ", ".join(f"{name}: {kind}" for name, kind in (x.rsplit(" ", 1) for x in ANSWER.split(", ")))


def _number(value, kind):
    found = re.search(r"-?\d+(?:\.\d+)?\s*%?", str(value))
    if not found:
        return None
    number = float(found[0].rstrip("% ")) / (100 if found[0].rstrip().endswith("%") else 1)
    return int(number) if kind is int else min(1.0, max(0.0, number))


def _lenient(text: str) -> dict:
    """The first object that decodes anywhere, else ``name: value`` lines, else the text as caption."""
    found: dict = {}
    decoder = json.JSONDecoder()
    for at in (m.start() for m in re.finditer(r"\{", text)):
        try:
            value, _ = decoder.raw_decode(text, at)
        except ValueError:
            continue
        if isinstance(value, dict):
            found = value
            break
    if not found:
        found = {m[1].strip().strip("\"'").lower(): m[2].strip().rstrip(",").strip("\"'") for m in re.finditer(r"(?m)^\s*([\w\"' ]{2,20}?)\s*[:=]\s*(.+)$", text)}
    named = {_NAMES.get(k, k): v for k, v in found.items()}
    out = {"caption": named.get("caption"), "ocr_text": named.get("ocr_text")}
    for key in _LISTS:
        value = named.get(key) or []
        items = value if isinstance(value, list) else re.split(r"[,;、，]", str(value).strip("[]"))
        out[key] = list(dict.fromkeys(x for i in items if (x := str(i).strip().strip("\"'"))))
    out["people_count"], out["confidence"] = _number(named.get("people_count"), int), _number(named.get("confidence"), float)
    if out["caption"] is None and not any(out[k] for k in ("ocr_text", *_LISTS)):
        out["caption"] = text.strip() or None
    return out


def _lenient_rows(texts: pd.Series) -> pd.DataFrame:
    rows = [_lenient(t) if isinstance(t, str) else dict.fromkeys(("caption", "ocr_text", *_LISTS, "people_count", "confidence")) for t in texts]
    frame = pd.DataFrame(rows, columns=["caption", "ocr_text", *_LISTS, "people_count", "confidence"])
    return frame.astype({"people_count": "Int32", "confidence": "Float64"})


def model_answer(text: Column, strategy: str = "auto_extract") -> Column:
    """A struct of ``ANSWER`` from a model's raw text: strict JSON by Spark itself, the helper only for what that cannot read.

    ``strict_json`` reads a text that is one JSON object, with or without a caption, and ``strip_markdown`` one in a code fence too;
    else the answer is null.
    """
    if strategy != "auto_extract":
        bare = F.trim(text if strategy == "strict_json" else F.replace(F.regexp_replace(text, r"```(?:json)?\s*", ""), F.lit("```")))
        return F.when(F.json_object_keys(bare).isNotNull(), F.from_json(bare, f"struct<{_ddl()}>"))
    strict = _strict(text)
    return F.coalesce(strict, F.pandas_udf(_lenient_rows, f"struct<{_ddl()}>")(F.when(strict.isNull(), text)))


# Words of a model's prose, the field they are a tag of, and the tag.
PROSE_WORDS = [
    ("夜", "scene_tags", "夜晚"), ("夜晚", "scene_tags", "夜晚"), ("建筑", "scene_tags", "建筑"), ("塔", "object_tags", "塔"), ("楼", "object_tags", "楼"), ("传统", "quality_tags", "传统"), ("清晰", "quality_tags", "清晰"), ("高清", "quality_tags", "高清"),
    ("划船", "activity_tags", "划船"), ("泛舟", "activity_tags", "划船"), ("游船", "activity_tags", "划船"), ("皮划艇", "activity_tags", "皮划艇"), ("night", "scene_tags", "夜晚"), ("architecture", "scene_tags", "建筑"), ("tower", "object_tags", "塔"), ("building", "object_tags", "楼"),
    ("traditional", "quality_tags", "传统"), ("high quality", "quality_tags", "高清"), ("clear", "quality_tags", "清晰"), ("boating", "activity_tags", "划船"), ("rowing", "activity_tags", "划船"), ("sailing", "activity_tags", "开船"), ("kayaking", "activity_tags", "皮划艇"),
    ("canoeing", "activity_tags", "独木舟"), ("boat", "object_tags", "船"), ("城市", "location_clues", "城市"), ("city", "location_clues", "城市"),
]


def prose_answer(text: Column, words: list[tuple[str, str, str]] = PROSE_WORDS) -> Column:
    """A struct (caption, scene_tags, object_tags, activity_tags, quality_tags, location_clues, search_keywords, people_count, confidence)
    from a model's prose, for answers without any JSON; null for a null or blank text.

    The caption is the first line that is neither blank, a brace nor a list item; tags are those whose word the text contains in any
    case; the number of people and the confidence (a number or a percentage, 0 to 1) are read behind their names, else 0, and 0.75,
    0.35 or 0.5 as the text calls it high, low or neither.
    """
    low = F.lower(text)
    lines = F.filter(F.transform(F.split(text, r"\r?\n"), lambda t: F.trim(t)), lambda t: (t != "") & ~t.isin("{", "}") & ~t.startswith("- "))
    fields = ("scene_tags", "object_tags", "activity_tags", "quality_tags", "location_clues")
    found = {f: F.array_distinct(F.array_compact(F.array(*(F.when(low.contains(word), tag) for word, field, tag in words if field == f)))) if any(w[1] == f for w in words) else F.array().cast("array<string>") for f in fields}
    count = F.coalesce(F.regexp_extract(low, r"people_count\s*[:：]\s*(\d+)", 1).try_cast("int"), F.regexp_extract(text, r"(?:人数|人们数量)\s*[:：]?\s*(\d+)", 1).try_cast("int"), F.lit(0))
    nobody = text.contains("无人") | text.contains("没有人") | low.contains("no people")
    said = F.concat(F.regexp_extract(low, r"confidence\s*[:：]\s*([0-9]+(?:\.[0-9]+)?%?)", 1))
    said = F.when(said != "", said).otherwise(F.regexp_extract(text, r"置信度\s*[:：]?\s*([0-9]+(?:\.[0-9]+)?%?)", 1))
    number = F.replace(said, F.lit("%"), F.lit("")).try_cast("double") / F.when(said.endswith("%"), 100.0).otherwise(1.0)
    tone = F.when(text.contains("高"), 0.75).when(text.contains("低"), 0.35).otherwise(0.5)
    confidence = F.when(said != "", F.greatest(F.lit(0.0), F.least(F.lit(1.0), number))).otherwise(tone)
    keywords = F.array_distinct(F.concat(found["scene_tags"], found["object_tags"], found["location_clues"]))
    answer = F.struct(F.coalesce(F.get(lines, F.lit(0)), F.lit("")).alias("caption"), *(c.alias(f) for f, c in found.items()), keywords.alias("search_keywords"), F.when(nobody, 0).otherwise(count).alias("people_count"), confidence.alias("confidence"))
    return F.when(F.trim(text) != "", answer)
