"""Quality rules: repetition inside a document, and lines that many documents of one host repeat.

Built-in functions only. A line is normalised (A-Z to lower case, digits to 0, white space to one space) and hashed. Per host it
is boilerplate when at least ``max_docs`` distinct texts hold it *and* these texts are otherwise different. They are told
apart by the hash of their longest line: either at least half of them differ in it, or ``max_docs`` of them are unrelated. For the
latter the line itself is left out, so that a notice longer than every article counts as well, and texts that share their second
longest other line are one, unless at least half of those differ in the longest; so a group of near copies counts once, however
large and wherever it was edited, and does not outweigh the different texts beside it. Exact copies count once. Boilerplate lines
are removed; a document that keeps too little is rejected.

Defined cases: a null text is empty (no words, fails the base rules); a null host is a host of its own; repeated rows
each get a row with the same verdict and count as one document; an empty table gives an empty result; other columns of
the input are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cohortlens.llm.tables import BLANK, ascii_lower, text_of, words_of, written

WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
#: A line in this many distinct texts of a host is above the limit.
MAX_DOCS = 20
#: A document is depleted when less than this share of its words is left.
MIN_LEFT_PERCENT = 30
SYMBOLS = "[#*$%&|<>]"
HAS_WORD = r"[^\x20\x09-\x0D]"


def repeated_words(words: Column) -> Column:
    """Number of words inside windows of five that stand in the text twice or more.

    Windows are hashed; only texts that repeat a window sort their windows. Each binding below is a lambda variable, so
    that no array is built again for every element.
    """
    n = F.size(words)
    grams = F.when(
        n >= WINDOW,
        F.transform(F.sequence(F.lit(1), F.greatest(n - (WINDOW - 1), F.lit(1))), lambda i: F.xxhash64(F.slice(words, i, WINDOW))),
    ).otherwise(F.array().cast("array<bigint>"))

    def starts(ordered: Column) -> Column:
        def twin(x: Column, k: Column) -> Column:
            before, after = F.get(ordered, k - 1)["h"], F.get(ordered, k + 1)["h"]
            return x["h"].eqNullSafe(before) | x["h"].eqNullSafe(after)

        return F.array_sort(F.transform(F.filter(ordered, twin), lambda x: x["at"]))

    def covered(at: Column) -> Column:
        first = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("bigint").alias("total"))
        step = lambda acc, i: F.struct(
            i.alias("last"), (acc["total"] + F.least(F.lit(WINDOW), i - acc["last"]).cast("bigint")).alias("total")
        )
        return F.aggregate(at, first, step)["total"]

    def count(g: Column) -> Column:
        ordered = F.array_sort(F.transform(g, lambda h, k: F.struct(h.alias("h"), k.alias("at"))))
        found = F.transform(F.array(ordered), starts)
        return F.when(
            F.size(F.array_distinct(g)) == F.size(g), F.lit(0).cast("bigint")
        ).otherwise(F.transform(found, covered)[0])

    return F.transform(F.array(grams), count)[0]


def line_key(line: Column) -> Column:
    """The first 60 bits of the MD5 of the normalised line."""
    plain = F.regexp_replace(F.regexp_replace(ascii_lower(line), "[0-9]+", "0"), BLANK + "+", " ")
    return F.conv(F.substring(F.md5(F.trim(plain)), 1, 15), 16, 10).cast("bigint")


def lines_of(text: Column) -> Column:
    """Lines with a word."""
    return F.filter(F.split(text, "\n"), lambda x: x.rlike(HAS_WORD))


def measure(docs: DataFrame, host: str = "source") -> DataFrame:
    """One row per document: base counts, and its lines as (key, words, length)."""
    kept = docs.select(F.col("doc_id"), F.col(host).cast("string").alias("host"), text_of(docs).alias("text"))
    split = kept.select("doc_id", "host", "text", words_of(F.col("text")).alias("words"), lines_of(F.col("text")).alias("raw"))
    lines = F.transform(
        "raw",
        lambda x: F.struct(
            line_key(x).alias("key"), F.regexp_count(x, F.lit(HAS_WORD + "+")).alias("words"), F.length(x).alias("chars")
        ),
    )
    return split.select(
        "doc_id",
        "host",
        F.xxhash64("text").alias("text_key"),
        F.size("words").cast("bigint").alias("n_words"),
        F.length(F.array_join("words", "")).cast("bigint").alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("bigint").alias("n_symbols"),
        (F.size("raw") - F.size(F.array_distinct("raw"))).cast("bigint").alias("n_dup_lines"),
        repeated_words(F.col("words")).alias("n_repeat_words"),
        lines.alias("lines"),
    )


def frequent_lines(measured: DataFrame, max_docs: int = MAX_DOCS) -> DataFrame:
    """(host, key, n_docs): lines above the limit. Every step aggregates on the map side first."""
    longest = F.array_max(F.transform("lines", lambda x: F.struct(x["chars"], x["key"])))["key"]
    keys = F.explode(F.array_distinct(F.transform("lines", lambda x: x["key"])))
    rows = measured.select("host", "text_key", longest.alias("body"), keys.alias("key")).distinct()
    bodies = rows.groupBy("host", "key", "body").agg(F.count(F.lit(1)).alias("n"))
    found = bodies.groupBy("host", "key").agg(F.sum("n").alias("n_docs"), F.count(F.lit(1)).alias("n_bodies"))
    found = written(found.filter(F.col("n_docs") >= max_docs), "quality-frequent")
    differ = 2 * F.col("n_bodies") >= F.col("n_docs")
    unrelated = _unrelated(measured, found.filter(~differ)).filter(F.col("n_unrelated") >= max_docs)
    return found.filter(differ).drop("n_bodies").unionByName(unrelated.drop("n_unrelated"))


def _unrelated(measured: DataFrame, doubtful: DataFrame) -> DataFrame:
    """(host, key, n_docs, n_unrelated): texts with the line, near copies as one."""

    def longest(but: list[str]) -> Column:
        others = F.filter("lines", lambda x: ~x["key"].isin(*[F.col(k) for k in but])) if but else F.col("lines")
        return F.array_max(F.transform(others, lambda x: F.struct(x["chars"], x["key"])))["key"]

    keys = F.explode(F.array_distinct(F.transform("lines", lambda x: x["key"])))
    top = measured.withColumn("k1", longest([])).withColumn("k2", longest(["k1"])).withColumn("k3", longest(["k1", "k2"]))
    rows = top.select("host", "text_key", "k1", "k2", "k3", keys.alias("key"))
    of = doubtful.select(F.col("host").alias("of_host"), F.col("key").alias("of_key"), "n_docs")
    rows = rows.join(of, rows["host"].eqNullSafe(of["of_host"]) & (rows["key"] == of["of_key"]))
    first = F.when(F.col("key") == F.col("k1"), F.col("k2")).otherwise(F.col("k1"))
    second = F.when(F.col("key").isin(F.col("k1"), F.col("k2")), F.col("k3")).otherwise(F.col("k2"))
    line = ["host", "key", "n_docs"]
    rows = rows.select(*line, "text_key", first.alias("first"), F.coalesce(second, first).alias("second")).distinct()
    pairs = rows.groupBy(*line, "second", "first").agg(F.count(F.lit(1)).alias("n"))
    groups = pairs.groupBy(*line, "second").agg(
        F.min("first").alias("one"), F.count(F.lit(1)).alias("differ"), F.sum("n").alias("n")
    )
    more = F.when(2 * F.col("differ") >= F.col("n"), F.col("differ") - 1).otherwise(0)
    ones = groups.groupBy(*line, "one").agg(F.sum(more).alias("more"))
    return ones.groupBy(*line).agg((F.count(F.lit(1)) + F.sum("more")).alias("n_unrelated"))


def quality_rules(
    docs: DataFrame, host: str = "source", max_docs: int = MAX_DOCS, min_left_percent: int = MIN_LEFT_PERCENT
) -> DataFrame:
    """One row per document: base counts, removed lines (count, words, keys) and the verdict."""
    measured = written(measure(docs, host), "quality-lines")
    frequent = frequent_lines(measured, max_docs)
    who = ["doc_id", "text_key", "host"]
    rows = measured.select(*who, F.posexplode("lines").alias("at", "line")).select(*who, "at", "line.key", "line.words")
    # A repeated row repeats its lines; one (document, text) needs them once.
    once = rows.groupBy(*who, "at", "key").agg(F.first("words").alias("words"))
    limit = frequent.select(F.col("host").alias("at_host"), F.col("key").alias("at_key"))
    hits = once.join(limit, once["host"].eqNullSafe(limit["at_host"]) & (once["key"] == limit["at_key"]), "left_semi")
    removed = hits.groupBy(*[F.col(c).alias(f"of_{c}") for c in who]).agg(
        F.sum("words").alias("removed_words"),
        F.count(F.lit(1)).alias("removed_lines"),
        F.collect_set("key").alias("removed_keys"),
    )
    same = [F.col(c).eqNullSafe(F.col(f"of_{c}")) for c in who]
    out = measured.drop("lines").join(removed, same[0] & same[1] & same[2], "left").drop(*[f"of_{c}" for c in who])
    out = out.fillna(0, ["removed_words", "removed_lines"])
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    left = F.col("n_words") - F.col("removed_words")
    depleted = (F.col("removed_words") > 0) & (
        (left < MIN_WORDS) | (100 * left < min_left_percent * F.col("n_words"))
    )
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & ~depleted)


def without_lines(text: Column, keys: Column) -> Column:
    """The text without the lines whose keys are listed; as it is where the list is null."""
    left = F.filter(F.split(text, "\n"), lambda x: ~F.array_contains(keys, line_key(x)))
    return F.when(keys.isNull(), text).otherwise(F.array_join(left, "\n"))


def clean_documents(docs: DataFrame, host: str = "source", **limits) -> DataFrame:
    """Documents that pass, with boilerplate lines removed and ``n_chars`` of what is left; columns as they came."""
    verdicts = quality_rules(docs, host, **limits).filter("kept").groupBy(
        F.col("doc_id").alias("_of_doc"), F.col("text_key").alias("_of_text"), F.col("host").alias("_of_host")
    ).agg(F.first("removed_keys").alias("_removed"))
    on = (
        docs["doc_id"].eqNullSafe(verdicts["_of_doc"])
        & (F.xxhash64(text_of(docs)) == verdicts["_of_text"])
        & docs[host].cast("string").eqNullSafe(verdicts["_of_host"])
    )
    keys = verdicts["_removed"]
    text = F.when(keys.isNull(), docs["text"]).otherwise(without_lines(text_of(docs), keys))
    fresh = {"text": text}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        fresh["n_chars"] = F.when(keys.isNull(), docs["n_chars"]).otherwise(F.length(text).cast(kind))
    return docs.join(verdicts, on, "inner").select(*[fresh.get(c, docs[c]).alias(c) for c in docs.columns])
