"""Problem 3: texts that were cut at a fixed length or in mid-transfer.

Method: for each source, histograms of the text length in characters and in bytes; a spike is a
length that far more texts share than its neighbourhood, most of them without a proper end.
Texts at a spike length without terminal punctuation are cut (and those with one too, where the
spike holds far more of them than chance). Beside that: a mark
at the cut (an ellipsis, "[more]"), and, for cuts in mid-transfer at any length, the last words: a
final line without terminal punctuation is cut when its last two words (the last one whole or as
the beginning of a word) go on inside lines ``GOES_ON`` times as often as they end anything, or
when they stand nowhere else in the corpus. Going on and ending grow alike with the corpus, so
the decision on a text is a ratio and no count.

Scale: histograms and counts of word pairs are map-side combined; prefixes are made of distinct
pairs only and joined by equality; windows run over distinct lengths of a source, not over its
rows, so a source with a third of all rows is no hot group. Everything stays in JVM expressions.

Defined results: null, empty and blank texts are not cut; a text that ends in a line break is
complete unless it stands on a spike; copies of a text count once in a histogram and come out
each; a null source counts as ''; other columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import cut, query_reading

#: Marks that sites put at a cut (fixed values).
MARK = r"(?:…|\.\.\.)\s*(?:\(more\)|\[more\]|read more|more|continue reading)?$|[\[(]more[\])]$|\bread more$"
#: Endings that look like a mark and close a sentence (fixed values).
PHRASE = r"\b(?:much more|and more|etc|u\.?s\.?w)\s*(?:…|\.\.\.)$"
TERMINAL = r"[.!?:;)”»…☕]$"
#: A spike has this many texts and this many times the mean of its neighbourhood.
SPIKE_TEXTS, SPIKE_TIMES, AROUND = 5, 10, 25
#: Words that go on so many times as often as they end are cut; so many characters of the last word are compared.
GOES_ON, LONGEST = 10, 64


def _tail(line):
    """The last two words of a (lower-case) line, digits made equal, full stop off."""
    return F.substring_index(F.rtrim(line, F.lit(" .\r\t ")), " ", -2)


def _facts(rows: DataFrame, key: str) -> DataFrame:
    text = rows.select(F.col(key).alias("ord"), F.coalesce("source", F.lit("")).alias("source"), F.col("desc").alias("d")).filter("trim(d) <> ''")
    text = text.withColumn("lines", F.split(F.translate(F.lower(F.rtrim("d", F.lit(" \r\n\t "))), "012345678", "999999999"), "\n"))
    text = text.withColumn("last", F.rtrim(F.element_at("lines", -1), F.lit(" \r\t ")))
    return text.select(
        "ord", "source", F.xxhash64("d").alias("h"), F.length("d").alias("chars"), F.octet_length("d").alias("bytes"),
        _tail(F.col("last")).alias("tail"), F.col("d").rlike(r"[\n]\s*\z").alias("closed"),
        F.col("last").rlike(TERMINAL).alias("terminal"), F.col("last").rlike(MARK).alias("mark"), F.col("last").rlike(PHRASE).alias("phrase"),
    )


def spikes(facts: DataFrame) -> DataFrame:
    """``source, measure, len, near, full``: lengths that a source cuts at.

    ``full`` says that even texts with a proper end are too many there to be chance.
    """
    both = F.explode(F.array(F.struct(F.lit("chars").alias("measure"), F.col("chars").alias("len")), F.struct(F.lit("bytes").alias("measure"), F.col("bytes").alias("len"))))
    proper = F.col("terminal") & ~(F.col("mark") & ~F.col("phrase"))
    hist = (
        facts.select("source", "h", proper.alias("proper"), both.alias("m"))
        .groupBy("source", "m.measure", "m.len", "h").agg(F.max("proper").alias("proper"))
        .groupBy("source", "measure", "len").agg(F.count("*").alias("n"), F.sum(F.col("proper").cast("int")).alias("n_proper"))
    )
    by = Window.partitionBy("source", "measure").orderBy("len")
    around = F.coalesce(F.sum("n").over(by.rangeBetween(-AROUND, -4)), F.lit(0)) + F.coalesce(F.sum("n").over(by.rangeBetween(1, AROUND)), F.lit(0))
    hist = hist.withColumn("mean", around / (2 * AROUND - 3))
    hist = hist.withColumn(
        "spike", (F.col("n") >= SPIKE_TEXTS) & (F.col("n") >= SPIKE_TIMES * F.col("mean") + 2) & (F.col("n_proper") <= 0.5 * F.col("n"))
    )
    above = F.max(F.when(F.col("spike"), F.col("len"))).over(by.rangeBetween(1, 3))
    return (
        hist.withColumn("above", above)
        .withColumn("near", ~F.col("spike") & F.col("above").isNotNull() & (F.col("n") - F.col("n_proper") >= 4 * F.col("mean") + 1))
        .filter("spike or near")
        .select("source", "measure", "len", "near", (F.col("spike") & (F.col("n_proper") > 3 * F.col("mean") + 1)).alias("full"))
    )


def line_pairs(rows: DataFrame) -> DataFrame:
    """``pair, n_in, n_inner``: how often two neighbouring words stand in a text, its end left out, and how often they close a line there.

    The first word of a line counts as a pair of its own, so a line of one word has a tail as well.
    """
    lines = F.split(F.translate(F.lower(F.rtrim("desc", F.lit(" \r\n\t "))), "012345678", "999999999"), "\n")
    words = F.split(F.rtrim(F.col("line"), F.lit(" .\r\t ")), " ")
    return (
        rows.filter("trim(desc) <> ''").select(lines.alias("lines"))
        .select(F.size("lines").alias("m"), F.posexplode("lines").alias("j", "line"))
        .select((F.col("j") == F.col("m") - 1).alias("end"), words.alias("words"))
        .select("end", F.size("words").alias("k"), F.posexplode(F.arrays_zip(F.concat(F.array(F.lit("")), "words").alias("a"), F.col("words").alias("b"))).alias("i", "w"))
        .filter("i < k - 1 or i = k - 1 and not end").select(F.when(F.col("i") == 0, F.col("w.b")).otherwise(F.concat("w.a", F.lit(" "), "w.b")).alias("pair"), (F.col("i") == F.col("k") - 1).cast("int").alias("closes"))
        .groupBy("pair").agg(F.count("*").alias("n_in"), F.sum("closes").alias("n_inner"))
        .filter("pair <> ''")
    )


def tail_counts(facts: DataFrame, pairs: DataFrame) -> DataFrame:
    """``tail, n_inner, n_final, n_texts, n_on``: how often the last two words of a text close inner lines, texts and
    distinct texts, and how often they, or words that begin like them, go on inside a line."""
    finals = (
        facts.groupBy("tail", "h").agg(F.count("*").alias("n"), F.max(~F.col("terminal") & ~F.col("closed")).alias("open"))
        .groupBy("tail").agg(F.sum("n").alias("n_final"), F.count("*").alias("n_texts"), F.max("open").alias("open"))
    )
    inner = pairs.filter("n_inner > 0").select(F.col("pair").alias("tail"), "n_inner")
    tails = cut(finals.filter("tail <> ''").join(inner, "tail", "left").fillna(0, ["n_inner"]))
    # prefixes of the second word join by equality; past LONGEST characters of it the rest is not compared
    head = F.length("pair") - F.length(F.substring_index("pair", " ", -1))
    upto = lambda n: F.substring("pair", F.lit(1), n)
    begun = pairs.select("n_in", F.explode(F.transform(F.sequence(head, F.least(F.length("pair"), head + LONGEST)), upto)).alias("start"))
    asked = tails.filter("open and n_inner < n_final").select("tail", F.substring("tail", F.lit(1), F.length("tail") - F.length(F.substring_index("tail", " ", -1)) + LONGEST).alias("start"))
    on = asked.join(begun, "start").groupBy("tail").agg(F.sum("n_in").alias("n_begun"))
    return tails.join(on, "tail", "left").select("tail", "n_inner", "n_final", "n_texts", (F.coalesce("n_begun", F.lit(0)) - F.col("n_inner")).alias("n_on"))


def cut_texts(rows: DataFrame, key: str = "ord") -> DataFrame:
    """``ord, source, how``: texts that were cut, ``how`` naming the first evidence."""
    facts = cut(_facts(rows, key))
    at = spikes(facts)
    chars = at.filter("measure = 'chars'").select("source", F.col("len").alias("chars"), F.col("near").alias("near_c"), F.col("full").alias("full_c"))
    octets = at.filter("measure = 'bytes'").select("source", F.col("len").alias("bytes"), F.col("near").alias("near_b"), F.col("full").alias("full_b"))
    open_end = ~F.col("terminal") & ~F.col("closed")
    # two words that go on far more often than they end anything were cut, however many texts end there
    tails = tail_counts(facts, cut(line_pairs(rows)))
    judged = facts.join(chars, ["source", "chars"], "left").join(octets, ["source", "bytes"], "left").join(tails, "tail", "left")
    inner, final, on = F.coalesce("n_inner", F.lit(0)), F.coalesce("n_final", F.lit(0)), F.coalesce("n_on", F.lit(0))
    alone = (inner == 0) & (on == 0) & (F.coalesce("n_texts", F.lit(0)) <= 1)
    how = (
        F.when(F.col("mark") & ~F.col("phrase"), "mark")
        .when((F.col("near_c").isNotNull() & (open_end | F.col("full_c"))) | (F.col("near_b").isNotNull() & (open_end | F.col("full_b"))), "spike")
        .when(F.col("closed") | F.col("terminal") & ~F.col("tail").endswith(":"), F.lit(None))
        .when((inner < final) & (on >= GOES_ON * (inner + final)) | alone, "words")
    )
    return judged.select("ord", "source", how.alias("how")).filter("how is not null")


@query_reading("postings")
def p3_found(postings: DataFrame) -> DataFrame:
    """The postings whose text was cut."""
    return cut_texts(postings).select("ord")


@query_reading("postings")
def p3_sources(postings: DataFrame) -> DataFrame:
    """How often each source cuts its texts."""
    found = cut_texts(postings).groupBy("source").agg(F.count("*").alias("n_cut"))
    totals = postings.groupBy(F.coalesce("source", F.lit("")).alias("source")).agg(F.count("*").alias("n_rows"))
    n_cut = F.coalesce("n_cut", F.lit(0).cast("bigint"))
    return totals.join(found, "source", "left").select("source", "n_rows", n_cut.alias("n_cut"), F.round(n_cut / F.col("n_rows"), 6).alias("share"))


QUERIES = {"p3_found": p3_found, "p3_sources": p3_sources}
