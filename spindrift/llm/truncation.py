"""Texts that stop before their own end: cut by a limit of their source or in transfer.

The vocabulary of the collection is laid out as a trie whose nodes are rows (a prefix and how many known words go on
from it), so it grows with the data like any table. Evidence, all of it counted over all texts:

* ``prefix``: the last token is no known word but a proper prefix of known ones;
* ``limit``: the text has exactly a length (in characters or bytes) at which cut texts of its source pile up, and no full stop;
* ``marker``: a sign of omission was put after the cut;
* ``open``: the last line is prose - lines that begin like it end with a full stop elsewhere - and has none. This one is
  an addition to the method: a text cut behind a whole word shows in no vocabulary. It is reported apart.

What was put after the cut is taken off first. A full stop, whatever the length, means that the text is whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.session import written

#: Texts that must hold a word for it to be known; lines from which the habits of a beginning are known; share of them that may lack a stop.
KNOWN, LINES, HABIT = 2, 5, 0.1
#: For a limit: different texts at one length, how many times more than at any length of the next NEAR, and the share of them with other evidence.
PEAK, TIMES, NEAR, OPEN = 3, 4, 20, 0.5
#: Words from which a line of unknown beginning counts as prose.
LONG = 6

#: Signs of omission at the end of a text, and what closes a sentence (with closing quotes and brackets).
MARKER = r"(?:\s*(?:\[(?:truncated|more|cut|\.\.\.|…)\]|\((?:truncated|more|cut|\.\.\.|…)\)|\.\.\.|…|�+))+\s*$"
SPACE = " \t\r\n\u00a0\u3000"
#: Characters in which signs of omission are looked for first; where they fill them, in the whole text.
MARKS = 64
STOP = r"[.!?。！？:;][\"'”»’)\]`]*$"


def _ending(texts: DataFrame) -> DataFrame:
    """Per text: what is left without markers, its last line and last token, and the lengths of the whole."""
    rows = texts.select(
        "doc_id", "source", F.length("text").alias("chars"), F.octet_length("text").alias("bytes"), F.xxhash64("text").alias("print"),
        F.rtrim("text", F.lit(SPACE)).alias("whole")
    )
    marks = lambda part: F.length(F.regexp_extract(part, MARKER, 0))
    rows = rows.withColumn("marks", marks(F.right("whole", F.lit(MARKS))))
    rows = rows.withColumn("marks", F.when(F.col("marks") >= MARKS - 16, marks(F.col("whole"))).otherwise(F.col("marks")))
    body = F.rtrim(F.substring("whole", F.lit(1), F.length("whole") - F.col("marks")), F.lit(SPACE))
    rows = rows.select(
        "doc_id", "source", "chars", "bytes", "print", (F.col("marks") > 0).alias("marker"), F.substring_index(body, "\n", -1).alias("line")
    )
    return rows.withColumn("token", F.lower(F.regexp_extract("line", r"(\p{L}+)$", 1)))


def _beginning(line: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(line, r"^\s*(\S+)", 1), r"\d", "0")


def vocabulary(texts: DataFrame) -> DataFrame:
    """Words and the number of texts that hold them elsewhere than at their very end: word, texts."""
    words = F.split(F.trim(F.lower(F.regexp_replace("text", r"[^\p{L}]+", " "))), " ")
    inner = F.array_distinct(F.slice("words", 1, F.greatest(F.lit(0), F.size("words") - 1)))
    return (
        texts.select(words.alias("words")).select(F.explode(inner).alias("word")).where("word <> ''").groupBy("word").agg(F.count("*").alias("texts"))
    )


def trie(words: DataFrame) -> DataFrame:
    """The inner nodes of the trie of ``words``: prefix, below (known words that go on from it)."""
    cut = F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.substring("word", F.lit(1), i))
    return words.where(F.length("word") > 1).select(F.explode(cut).alias("prefix")).groupBy("prefix").agg(F.count("*").alias("below"))


def limits(judged: DataFrame) -> DataFrame:
    """Lengths at which the texts of a source pile up cut: source, measure, size. Copies count once."""
    once = judged.groupBy("source", "chars", "bytes", "print").agg(F.max("other").alias("other"))
    sized = once.select(
        "source", "other", F.explode(F.map_from_arrays(F.array(F.lit("chars"), F.lit("bytes")), F.array("chars", "bytes"))).alias("measure", "size")
    )
    at = sized.groupBy("source", "measure", "size").agg(F.count("*").alias("n"), F.sum(F.col("other").cast("int")).alias("cut_n"))
    # a peak is compared with the lengths beside it by equality, so no source's lengths meet in one task
    peaks = at.where((F.col("n") >= PEAK) & (F.col("cut_n") >= OPEN * F.col("n")))
    near = peaks.select("source", "measure", "size", "n", F.explode(F.array(*[F.col("size") + d for d in range(-NEAR, NEAR + 1) if d])).alias("s2"))
    other = at.select(F.col("source").alias("o_source"), F.col("measure").alias("o_measure"), F.col("size").alias("o_size"), F.col("n").alias("o_n"))
    on = F.col("source").eqNullSafe(F.col("o_source")) & (F.col("measure") == F.col("o_measure")) & (F.col("s2") == F.col("o_size"))
    beside = near.join(other, on, "left").groupBy("source", "measure", "size", "n").agg(F.coalesce(F.max("o_n"), F.lit(0)).alias("beside"))
    return beside.where(F.col("n") >= TIMES * F.col("beside")).select("source", "measure", "size")


def endings(documents: DataFrame) -> DataFrame:
    """Every text with its evidence: doc_id, source, marker, prefix, open, limit, cut.

    Null and empty texts are whole. A text of copies is judged like any other; ``source`` may be null (a source of its
    own). No texts give no rows.
    """
    texts = documents.where("doc_id is not null").select("doc_id", "source", F.coalesce("text", F.lit("")).alias("text"))
    ends = _ending(texts).withColumn("start", _beginning(F.col("line")))
    ends = ends.withColumn("open_end", (F.col("line") != "") & ~F.col("line").rlike(STOP))
    ends, _ = written(
        ends.withColumn("words", F.size(F.split(F.trim("line"), r"\s+")))
            .withColumn("inner_stop", F.col("line").rlike(r"[.!?。！？][\"'”»’)]*\s+\S|[。！？]\S"))
            .withColumn("kana", F.col("line").rlike(r"[぀-ヿ]"))
            .drop("line"),
        "endings"
    )

    lines = texts.select(F.explode(F.split("text", "\n")).alias("line")).where(F.length(F.trim("line")) > 0)
    habit = (
        lines.select(_beginning(F.col("line")).alias("h_start"), F.rtrim("line", F.lit(SPACE)).rlike(STOP).alias("stop"))
            .groupBy("h_start")
            .agg(F.count("*").alias("h_lines"), F.sum((~F.col("stop")).cast("int")).alias("h_open"))
    )
    words, _ = written(vocabulary(texts).where(F.col("texts") >= KNOWN), "words")
    tokens = ends.where("open_end and token <> ''").select(F.col("token").alias("t")).distinct()
    unknown = tokens.join(words.select(F.col("word").alias("t")), "t", "left_anti")
    prefixes = unknown.join(trie(words).select(F.col("prefix").alias("t")), "t", "left_semi").select("t", F.lit(True).alias("is_prefix"))

    rows = ends.join(habit, F.col("start") == F.col("h_start"), "left").join(prefixes, F.col("token") == F.col("t"), "left")
    open_end = F.col("open_end")
    share = F.coalesce(F.col("h_open") / F.col("h_lines"), F.lit(1.0))
    familiar = F.coalesce(F.col("h_lines"), F.lit(0)) >= LINES
    fixed = familiar & (share >= 1 - HABIT)
    prose = (
        (familiar & (share <= HABIT))
        | (~fixed & ((F.col("words") >= LONG) | F.col("inner_stop") | F.col("kana")))
        | (F.col("inner_stop") & (F.col("words") >= 2 * LONG))
    )
    rows = rows.select(
        "doc_id", "source", "chars", "bytes", "print", "open_end", (F.col("marker") & open_end).alias("marker"),
        (open_end & F.coalesce("is_prefix", F.lit(False))).alias("prefix"), (open_end & prose).alias("open")
    )
    judged, _ = written(rows.withColumn("other", F.col("marker") | F.col("prefix") | F.col("open")), "judged")

    found = limits(judged)
    chars = found.where("measure = 'chars'").select(F.col("source").alias("c_source"), F.col("size").alias("c_size"))
    octets = found.where("measure = 'bytes'").select(F.col("source").alias("b_source"), F.col("size").alias("b_size"))
    out = judged.join(chars, F.col("source").eqNullSafe(F.col("c_source")) & (F.col("chars") == F.col("c_size")), "left")
    out = out.join(octets, F.col("source").eqNullSafe(F.col("b_source")) & (F.col("bytes") == F.col("b_size")), "left")
    at_limit = F.col("open_end") & (F.col("c_size").isNotNull() | F.col("b_size").isNotNull())
    return out.select("doc_id", "source", "marker", "prefix", "open", at_limit.alias("limit"), (F.col("other") | at_limit).alias("cut"))


def truncated(documents: DataFrame) -> DataFrame:
    """The texts that were cut: doc_id."""
    return endings(documents).where("cut").select("doc_id")


def by_source(documents: DataFrame) -> DataFrame:
    """How often each source truncates: source, texts, cut, share, by which evidence, and by vocabulary, length or marker (``by_method``) or by nothing but open prose (``by_open_only``)."""
    found = endings(documents).withColumn("method", F.expr("prefix or `limit` or marker")).withColumn("open_only", F.expr("cut and not method"))
    count = lambda c: F.sum(F.col(c).cast("int")).cast("long").alias(f"by_{c}")
    return (
        found.groupBy("source")
            .agg(
                F.count("*").alias("texts"), F.sum(F.col("cut").cast("int")).cast("long").alias("cut"),
                F.round(F.avg(F.col("cut").cast("double")), 6).alias("share"),
                *[count(c) for c in ("marker", "prefix", "open", "limit", "method", "open_only")]
            )
    )
