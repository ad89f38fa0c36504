"""An inverted index of photos' texts and tags, and the terms of many requests looked up in it; or, for one batch, in the texts themselves.

Texts are cut at white space. ``postings`` has a row for each different word of each text and tag, ``words`` each different word once.
A term without white space occurs in a text if a word contains it: its rarest character trigram (of all words) meets the words' trigrams,
and the few words met are compared. Of a term with white space the longest part is looked up so, and the texts found are compared.

Of invented or misread texts nearly every word is new, and an index is larger than its texts. One batch (``text_hits``) reads the texts once
and compares each with the different terms of its project where it lies: nothing of a text is shuffled or written, only its hits.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoebox.sources.files import written

#: Weight of a term found in a field; tag fields count for every matching tag.
TEXT_WEIGHTS = {"caption": 3, "ocr_text": 5, "file_name": 1}
TAG_WEIGHTS = {"scene_tags": 4, "object_tags": 4, "activity_tags": 4, "search_keywords": 4, "quality_tags": 2, "location_clues": 2}
#: Fields that name things, fields in which unwanted terms count, and fields that hint at a place only.
ENTITY_FIELDS = {"caption", "object_tags", "search_keywords"}
NEGATIVE_FIELDS = {"caption", "ocr_text", "scene_tags", "object_tags", "activity_tags", "search_keywords", "location_clues"}
WEAK_FIELDS = {"search_keywords", "location_clues"}
#: Characters of a gram.
GRAM = 3
_SPACE = "\t\n\x0b\x0c\r"
#: The slot of all tags of a field in one text, with spaces between.
JOINED = -1


class TextIndex(NamedTuple):
    """``texts`` (project_id, photo_id, field, slot, text), ``postings`` (project_id, photo_id, field, slot, word) and ``words`` (word),
    lower-cased; ``slot`` is a tag's place."""

    texts: DataFrame
    postings: DataFrame
    words: DataFrame


def _spaced(text: Column) -> Column:
    return F.translate(text, _SPACE, " " * len(_SPACE))


def _of(one: Callable, field: str) -> Callable:
    return lambda text, slot: one(field, slot, text)


def _slots(rows: DataFrame, joined: bool = False) -> DataFrame:
    """(project_id, photo_id, field, slot, text) of each text and tag that is not null, or of the tags of each field in one text."""
    one = lambda field, slot, text: F.struct(F.lit(field).alias("field"), slot.cast("int").alias("slot"), F.lower(text).alias("text"))
    tags = {c: F.coalesce(c, F.array().cast("array<string>")) for c in TAG_WEIGHTS}
    if joined:
        parts = [F.array(*(one(c, F.lit(JOINED), F.array_join(t, " ")) for c, t in tags.items()))]
    else:
        parts = [F.array(*(one(c, F.lit(0), F.col(c)) for c in TEXT_WEIGHTS)), *(F.transform(t, _of(one, c)) for c, t in tags.items())]
    return rows.select(F.col("project_id").cast("bigint"), F.col("photo_id").cast("bigint"), F.inline(F.flatten(F.array(*parts)))).where("text <> ''")


def text_index(rows: DataFrame) -> TextIndex:
    """The index of rows (project_id, photo_id, the fields of ``TEXT_WEIGHTS`` and ``TAG_WEIGHTS``); postings and words are written.

    It is built once and answers any number of batches of requests: a batch reads the words, and of the postings their column of words and
    the rows met. Null texts and tags are skipped; a table without texts gives an empty index.
    """
    slots = _slots(rows)
    words = F.explode(F.array_distinct(F.split(_spaced(F.col("text")), " ")))
    postings = written(slots.select("project_id", "photo_id", "field", "slot", words.alias("word")).where("word <> ''"))
    return TextIndex(slots.union(_slots(rows, joined=True)), postings, written(postings.select("word").distinct()))


def _grams(text: Column, sizes: list[int] | None = None) -> Column:
    """Grams of ``sizes`` characters (up to ``GRAM``) that can meet a part of that length or, if it is longer, its own grams; one pass
    over the text for each size, however long it is."""
    every = [F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)) for n in sizes or range(1, GRAM + 1)]
    return F.array_distinct(F.concat(*every))


def _meeting(words: DataFrame, parts: DataFrame) -> DataFrame:
    """(part, word) of all words that contain a part; ``parts`` (part) are distinct and written."""
    own = F.when(F.length("part") < GRAM, F.array("part")).otherwise(F.transform(F.sequence(F.lit(1), F.length("part") - (GRAM - 1)), lambda i: F.substring("part", i, F.lit(GRAM))))
    grams = parts.select("part", F.explode(F.array_distinct(own)).alias("gram"))
    met = written(words.select("word", F.explode(_grams(F.col("word"))).alias("gram")).join(grams.select("gram").distinct(), "gram", "left_semi"))
    common = met.groupBy("gram").agg(F.count("*").alias("n"))
    rarest = grams.join(common, "gram").groupBy("part").agg(F.count("*").alias("present"), F.min_by("gram", F.struct("n", "gram")).alias("gram"))
    # A part with a gram that no word has is in no word.
    whole = grams.groupBy("part").agg(F.count("*").alias("all")).join(rarest, "part").where("all = present")
    return met.join(whole.select("part", "gram"), "gram").where(F.contains("word", "part")).select("part", "word").distinct()


def parts_within(rows: DataFrame, text: str, parts: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """``rows`` with each ``part`` (``by``…, part) of their group that their column ``text`` contains, a row for each.

    Different texts and parts meet by the part's rarest gram, then the rows that hold a text met are compared. A text takes part in the
    meeting as a digest, so its length only counts once. Null and empty texts and parts meet nothing.
    """
    keys = [*by, "text_digest"]
    marked = rows.where(F.col(text) != "").withColumn("text_digest", F.unhex(F.md5(text)))
    asked = written(parts.where("part <> ''").select(*by, "part").distinct())
    own = F.when(F.length("part") < GRAM, F.array("part")).otherwise(F.transform(F.sequence(F.lit(1), F.length("part") - (GRAM - 1)), lambda i: F.substring("part", i, F.lit(GRAM))))
    grams = asked.select(*by, "part", F.explode(F.array_distinct(own)).alias("gram"))
    sizes = [r[0] for r in asked.select(F.least(F.length("part"), F.lit(GRAM))).distinct().collect()]
    if not sizes:
        return marked.where("false").select(*rows.columns, F.col(text).alias("part"))
    # Different texts are cut once, however many rows hold them.
    texts = marked.select(*keys, F.col(text).alias("text")).distinct().select(*keys, F.explode(_grams(F.col("text"), sizes)).alias("gram"))
    met = written(texts.join(grams.select(*by, "gram").distinct(), [*by, "gram"], "left_semi"))
    counts = met.groupBy(*by, "gram").agg(F.count("*").alias("n"))
    rarest = grams.join(counts, [*by, "gram"], "left").groupBy(*by, "part").agg(F.count_if(F.col("n").isNull()).alias("absent"), F.min_by("gram", F.struct("n", "gram")).alias("gram")).where("absent = 0")
    pairs = met.join(rarest.select(*by, "part", "gram"), [*by, "gram"]).select(*keys, "part")
    return marked.join(pairs, keys).where(F.contains(text, "part")).select(*rows.columns, "part")


def term_hits(index: TextIndex, terms: DataFrame) -> DataFrame:
    """(project_id, photo_id, term, raw, anywhere, in_entity, in_negative, in_weak): terms that occur in a photo's texts or tags, in any case.

    ``terms`` are (project_id, term, alias), lower-cased; a term occurs where one of its aliases does. ``raw`` is the sum of the
    weights of the texts and tags that contain it; ``anywhere`` also counts aliases that run over several tags. An alias of nothing but
    white space is compared with every text of its project.
    """
    part = F.array_max(F.transform(F.split(_spaced(F.col("alias")), " "), lambda x: F.struct(F.length(x).alias("n"), x.alias("part"))))["part"]
    asked = written(terms.select("project_id", "term", "alias", part.alias("part"), F.contains(_spaced(F.col("alias")), F.lit(" ")).alias("several")).distinct())
    parts = written(asked.where("part <> ''").select("part").distinct())
    words = written(_meeting(index.words, parts).join(asked.where("part <> ''"), "part").select("project_id", "word", "term", "alias", "several").distinct())
    places = index.postings.join(words, ["project_id", "word"])
    found = places.where("NOT several").select("project_id", "photo_id", "term", "field", "slot")
    if not asked.where("several").isEmpty():
        near = places.where("several").select("project_id", "photo_id", "term", "alias").distinct()
        blank = index.texts.select("project_id", "photo_id").distinct().join(asked.where("part = ''").select("project_id", "term", "alias"), "project_id")
        compared = index.texts.join(near.union(blank.select(*near.columns)), ["project_id", "photo_id"]).where(F.contains("text", "alias"))
        found = found.union(compared.select(*found.columns))
    weights = F.create_map(*(F.lit(x) for pair in (TEXT_WEIGHTS | TAG_WEIGHTS).items() for x in pair))
    inside = lambda fields: F.bool_or((F.col("slot") != JOINED) & F.col("field").isin(*fields))
    # Dealt by photo and term once, for both groupings.
    keys = ["project_id", "photo_id", "term"]
    once = found.repartition(*keys).groupBy(*keys, "field", "slot").agg(F.lit(True).alias("hit"))
    raw = F.sum(F.when(F.col("slot") != JOINED, weights[F.col("field")]).otherwise(0).cast("double"))
    return once.groupBy(*keys).agg(raw.alias("raw"), F.lit(True).alias("anywhere"), inside(ENTITY_FIELDS).alias("in_entity"), inside(NEGATIVE_FIELDS).alias("in_negative"), inside(WEAK_FIELDS).alias("in_weak"))


#: Marks of a hit: in a field of ``ENTITY_FIELDS``, ``NEGATIVE_FIELDS``, ``WEAK_FIELDS``.
IN_ENTITY, IN_NEGATIVE, IN_WEAK = 1, 2, 4


def vocabularies(terms: DataFrame) -> DataFrame:
    """(project_id, vocabulary): the different terms of a project's requests (project_id, term, alias) in order, as (place, term, aliases)."""
    words = terms.groupBy("project_id", "term").agg(F.sort_array(F.collect_set("alias")).alias("aliases"))
    every = words.groupBy("project_id").agg(F.sort_array(F.collect_list(F.struct("term", "aliases"))).alias("v"))
    return every.select("project_id", F.transform("v", lambda v, i: F.struct(i.alias("place"), v["term"].alias("term"), v["aliases"].alias("aliases"))).alias("vocabulary"))


def named(vocabulary: Column | str, text: Column | str) -> Column:
    """The entries of a vocabulary with an alias that a lower-cased text contains."""
    return F.filter(vocabulary, lambda v: F.exists(v["aliases"], lambda a: F.contains(text, a)))


def text_hits(rows: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(project_id, photo_id, hits): for each row (project_id, photo_id, some of the fields) of a project with a vocabulary (project_id,
    vocabulary), which is broadcast, its terms that occur in the row's texts or tags, in any case, as (place, raw, marks): see ``term_hits``.
    """
    texts, tags = ([c for c in fields if c in rows.columns] for fields in (TEXT_WEIGHTS, TAG_WEIGHTS))
    marks = lambda field: IN_ENTITY * (field in ENTITY_FIELDS) + IN_NEGATIVE * (field in NEGATIVE_FIELDS) + IN_WEAK * (field in WEAK_FIELDS)
    slot = lambda field: lambda text: F.struct(text.alias("text"), F.lit((TEXT_WEIGHTS | TAG_WEIGHTS)[field]).cast("bigint").alias("weight"), F.lit(marks(field)).alias("marks"))
    low = {c: F.lower(c) for c in texts} | {c: F.transform(F.array_compact(F.coalesce(c, F.array().cast("array<string>"))), F.lower) for c in tags}
    slots = F.flatten(F.array(F.array(*(slot(c)(low[c]) for c in texts)), *(F.transform(low[c], slot(c)) for c in tags)))
    # Terms are looked for in all of a row's texts at once, the few found in each of them.
    whole = rows.select(F.col("project_id").cast("bigint"), F.col("photo_id").cast("bigint"), F.concat_ws(" ", *low.values()).alias("whole"), slots.alias("slots"), F.array(*(F.array_join(low[c], " ") for c in tags)).cast("array<string>").alias("joined"))
    nothing = F.struct(F.lit(0).cast("bigint").alias("raw"), F.lit(0).alias("marks"))

    def hit(entry: Column) -> Column:
        within = lambda text: F.exists(entry["aliases"], lambda a: F.contains(text, a))
        add = lambda s, x: F.when(within(x["text"]), F.struct((s["raw"] + x["weight"]).alias("raw"), s["marks"].bitwiseOR(x["marks"]).alias("marks"))).otherwise(s)
        found = F.aggregate("slots", nothing, add)
        return F.struct(entry["place"].alias("place"), found.alias("found"), F.exists("joined", within).alias("over"))

    hits = F.filter(F.transform(named("vocabulary", F.col("whole")), hit), lambda h: (h["found"]["raw"] > 0) | h["over"])
    flat = F.transform(hits, lambda h: F.struct(h["place"].alias("place"), h["found"]["raw"].alias("raw"), h["found"]["marks"].alias("marks")))
    return whole.join(F.broadcast(vocabulary), "project_id").select("project_id", "photo_id", flat.alias("hits"))
