"""Keyword lists of any size, kept as a table and met through an index of their rarest parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedsieve.session import materialize

_CJK = "[一-鿿]"
# Noncharacters that mark places in texts and keywords alike; no text holds them.
_EDGE, _END = "﷐", "﷑"
LEAD = 32  # characters of a keyword by which it meets the beginning of a text
GRAM = 5  # consecutive runs (three words and what is between) by which a keyword meets the inside of a text
SMALL = 100_000  # words of a dictionary that is broadcast


def _edges(text: Column) -> Column:
    """The text with a mark at every word boundary."""
    return F.regexp_replace(text, r"(?U)\b", _EDGE)


def _ends(text: Column) -> Column:
    """The text with a mark before every character that can end a web domain."""
    return F.regexp_replace(text, r"(?U)(?=[/?#\s])", _END)


def _runs(text: Column) -> Column:
    """Runs of word characters and runs of others, in order."""
    return F.regexp_extract_all(text, F.lit(r"(?U)\w+|\W+"), F.lit(0))


def _pairs(text: Column) -> Column:
    """CJK characters and pairs of characters that hold one, each once."""
    found = [F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in (f"({_CJK})", f"(?s)(?=({_CJK}.))", f"(?s)(?=(.{_CJK}))")]
    return F.when(text.rlike(_CJK), F.array_distinct(F.concat(*found))).otherwise(F.array().cast("array<string>"))


def _hashed(tag: str, keys: Column) -> Column:
    return F.transform(keys, lambda k: F.xxhash64(F.lit(tag), k))


def _with_grams(rows: DataFrame, runs: str) -> DataFrame:
    """Columns g1 to g<GRAM>: hashes of that many consecutive runs, by their first run."""
    rows = rows.withColumn("g1", _hashed("w", F.col(runs)))
    for n in range(2, GRAM + 1):
        left = F.greatest(F.size("g1") - (n - 1), F.lit(0))
        rows = rows.withColumn(f"g{n}", F.zip_with(F.slice(f"g{n - 1}", F.lit(1), left), F.slice("g1", F.lit(n), left), lambda a, b: F.xxhash64(a, b)))
    return rows


def _none() -> Column:
    return F.array().cast("array<bigint>")


def index(dictionary: DataFrame) -> DataFrame:
    """Distinct words of `dictionary` (keyword) with the parts that any text they match must hold.

    A keyword with CJK characters is matched as it is, any other in small letters. `parts`: hashes of GRAM consecutive runs
    of word characters or others (a match inside a text starts and ends at word boundaries, so they are whole runs there), or of all
    its runs if it has fewer; pairs of characters for a CJK keyword. `lead`: its first LEAD characters. `whole`: all runs in one
    part and word characters at both ends, so its part decides.
    """
    cjk = F.col("keyword").rlike(_CJK)
    words = dictionary.where("keyword <> ''").select(F.when(cjk, F.col("keyword")).otherwise(F.lower("keyword")).alias("word"), cjk.alias("cjk")).distinct()
    pairs = F.filter(_pairs(F.col("word")), lambda p: (F.length(p) == 2) | (F.length("word") == 1))
    grams = _with_grams(words.withColumn("runs", _runs(F.col("word"))), "runs")
    widest = F.col(f"g{GRAM}")
    for n in range(GRAM - 1, 0, -1):
        widest = F.when(F.size("runs") == n, F.col(f"g{n}")).otherwise(widest)
    return grams.select(
        F.xxhash64("word").alias("word_id"), "word", "cjk", F.when(F.col("cjk"), _hashed("c", pairs)).otherwise(F.array_distinct(widest)).alias("parts"),
        F.when(~F.col("cjk") & (F.length("word") >= 2), F.xxhash64(F.lit("l"), F.left("word", F.lit(LEAD)))).alias("lead"),
        (~F.col("cjk") & (F.size("runs") <= GRAM) & F.col("word").rlike(r"(?U)\A\w") & F.col("word").rlike(r"(?U)\w\z")).alias("whole"),
        F.concat(F.lit(_EDGE), F.regexp_replace(_edges(F.col("word")), f"^{_EDGE}|{_EDGE}$", ""), F.lit(_EDGE)).alias("inside"),
        F.concat(F.lit("."), _ends(F.col("word")), F.lit(_END)).alias("domain"))


def _parts_of(rows: DataFrame) -> DataFrame:
    """(key, part, sure) of texts: hashes of 1 to GRAM consecutive runs, CJK pairs, and beginnings of 2 to LEAD characters, each once.

    Runs are not sure where they also stand behind a dot, as a domain ending does.
    """
    low = rows.select("key", "text", F.lower("text").alias("low")).withColumn("all_runs", _runs(F.col("low")))
    word = lambda c: c.rlike(r"(?U)\A\w")
    # Runs of other characters at the ends of a text have no word boundary on one side.
    first = F.when(word(F.get("all_runs", F.lit(0))), 1).otherwise(2)
    last = F.size("all_runs") - F.when(word(F.get("all_runs", F.size("all_runs") - 1)), 0).otherwise(1)
    inner = F.slice("all_runs", first, F.greatest(last - first + 1, F.lit(0)))
    grams = _with_grams(low.withColumns({"first": first, "runs": inner}), "runs")
    g = [F.col(f"g{n}") for n in range(1, GRAM + 1)]
    dotted = F.transform("runs", lambda r, i: F.endswith(F.coalesce(F.get("all_runs", i + F.col("first") - 2), F.lit("")), F.lit(".")))
    behind = grams.withColumn("dotted", F.when(F.col("low").rlike(r"(?U)\.\w"), dotted))
    unsure = F.array_distinct(F.concat(*[F.filter(x, lambda v, i: F.get("dotted", i)) for x in g]))
    upto = F.least(F.lit(LEAD), F.length("low"))
    leads = F.when(upto >= 2, F.transform(F.sequence(F.lit(2), F.greatest(upto, F.lit(2))), lambda n: F.xxhash64(F.lit("l"), F.left("low", n)))).otherwise(_none())
    parts = F.array_distinct(F.concat(*g, _hashed("c", _pairs(F.col("text"))), leads))
    found = behind.select("key", parts.alias("parts"), F.when(F.col("dotted").isNotNull(), unsure).otherwise(_none()).alias("unsure"))
    # The arrays end here: behind an explode they would be copied for every part.
    tagged = lambda xs, sure: F.transform(xs, lambda p: F.struct(p.alias("part"), F.lit(sure).alias("sure")))
    both = F.concat(tagged(F.array_except("parts", "unsure"), True), tagged("unsure", False))
    return found.select("key", F.explode(both).alias("p")).select("key", "p.part", "p.sure")


def dictionary_hits(docs: DataFrame, dictionary: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, list, keyword) for every entry of `dictionary` (list, keyword) that matches a text of `docs`.

    The rule is that of `keyword_match`: a CJK keyword as a substring; any other at the beginning of the text, or as a whole word
    unless the text also holds it as a domain ending. `key` must be unique.

    No text meets the dictionary. Texts and keywords meet by equality of parts: postings of the parts that occur in the
    dictionary are stored once; each keyword then looks only at the postings of its rarest part, by their counts. A
    keyword of up to GRAM runs needs no more. For longer ones, CJK, and those with other characters at an end, the texts that hold the
    rarest part are read again and tested by plain substrings: the word boundaries and domain ends of the text are marked by fixed
    patterns, as those of the keyword. Parts and words are compared by 64-bit hashes.
    Tables that grow with the texts are never broadcast; those of a dictionary are if it is small by its count.

    Null or empty texts and keywords match nothing. An entry that repeats is returned each time. Empty input: empty result.
    """
    words = materialize(index(dictionary), "dictionary-words")
    small = words.count() <= SMALL

    def meet(many: DataFrame, few: DataFrame, on: str) -> DataFrame:
        return many.join(F.broadcast(few) if small else few.hint("merge"), on)

    wanted = words.select(F.explode(F.concat("parts", F.when(F.col("lead").isNull(), _none()).otherwise(F.array("lead")))).alias("part")).distinct()
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    postings = materialize(meet(_parts_of(rows), wanted, "part"), "dictionary-postings")

    counts = postings.groupBy("part").agg(F.count("*").alias("n"))
    rarest = words.select("word_id", "whole", F.explode("parts").alias("part")).join(counts, "part", "left").groupBy("word_id", "whole").agg(
        F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "part")).alias("least")).where("least.n > 0").select("word_id", "whole", F.col("least.part").alias("part"))
    met = meet(postings, rarest, "part")
    sure = met.where("whole AND sure").select("key", "word_id")
    short = F.length("word") <= LEAD
    leads = meet(postings, words.where("lead IS NOT NULL").select("word_id", short.alias("short"), F.col("lead").alias("part")), "part")
    doubtful = met.where("NOT whole OR NOT sure").select("key", "word_id").unionByName(leads.where("NOT short").select("key", "word_id")).distinct()

    tests = words.select("word_id", F.struct("word_id", "word", "cjk", "inside", "domain").alias("test"))
    asked = meet(doubtful, tests, "word_id").groupBy("key").agg(F.collect_list("test").alias("tests"))
    marked = rows.join(asked.hint("merge"), "key").withColumn("low", F.lower("text")).withColumns({"inner": _edges(F.col("low")), "ends": _ends(F.col("low"))})

    def holds(t: Column) -> Column:
        begins = (F.length(t["word"]) >= 2) & F.startswith("low", t["word"])
        return F.when(t["cjk"], F.contains("text", t["word"])).otherwise(begins | (F.contains("inner", t["inside"]) & ~F.contains("ends", t["domain"])))

    tested = marked.select("key", F.explode(F.filter("tests", holds)).alias("t")).select("key", "t.word_id")
    hits = sure.unionByName(leads.where("short").select("key", "word_id")).unionByName(tested).distinct()
    word = F.when(F.col("keyword").rlike(_CJK), F.col("keyword")).otherwise(F.lower("keyword"))
    entries = dictionary.where("keyword <> ''").select("list", "keyword", F.xxhash64(word).alias("word_id"))
    return meet(hits, entries, "word_id").select(F.col("key").alias(key), "list", "keyword")


def dictionary_counts(docs: DataFrame, dictionary: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, list, hits): matching entries of each list, for the texts that have any."""
    return dictionary_hits(docs, dictionary, key, text).groupBy(key, "list").agg(F.count("*").alias("hits"))
