"""Line dedup by an exact set-similarity join with prefix, positional and length filters.

A line's tokens are its distinct pairs of neighbouring words, A-Z lower-cased; single words are too few to be rare. A line of
under MIN_WORDS words has one token, all its words in order. A line goes if an earlier line, in the order (doc_id, line
number), has a token set of Jaccard similarity THRESHOLD or more; lines without words stay.

Two sets that similar share a token among the rarest few of each (the prefix). The order is by a rarity class,
taken from counts in a fixed number of hash buckets over the whole corpus, then by hash; any fixed order is
exact, a rough rarity makes it fast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vitalframe.llm.common import GAP, LOWER, UPPER, WORD, documents, stored

MIN_WORDS = 5
#: Blanks inside a line besides the space.
OTHER_BLANKS = "\t\v\f\r"
#: Jaccard threshold in hundredths.
THRESHOLD = 85
#: Buckets of the rarity counts; the table of one small number per bucket is part of the plan.
BUCKETS = 1 << 16
#: Documents whose wanted line numbers are broadcast at most; more are joined by shuffle.
WANTED = 300_000


def _pairs(words: Column) -> Column:
    """64-bit hashes of neighbouring words."""
    n = F.greatest(F.size(words) - 1, F.lit(0))
    return F.zip_with(F.slice(words, 1, n), F.slice(words, 2, n), lambda x, y: F.xxhash64(x, y))


def lines_of(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, line) of all lines."""
    return docs.filter("text is not null and doc_id is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


def each_line(rows: DataFrame, make, least: int) -> DataFrame:
    """(doc_id, line_no, made): ``make(words)`` of every line with at least ``least`` words.

    The words are bound once by an array of one element and a generator, so no later step splits a line again.
    """
    # Only A-Z are to change. lower() does that to ASCII lines. Others are read byte by byte as Latin-1 first: this also
    # turns lead bytes C0-DE into E0-FE, but the number of bytes that follow still tells them apart, so words
    # are equal as before. translate() takes about five times as long.
    bytewise = F.decode(F.col("line").cast("binary"), "ISO-8859-1")
    folded = F.lower(F.when(F.length("line") == F.octet_length("line"), F.col("line")).otherwise(bytewise))
    # a split at one plain character needs no regular expression
    blanks = F.lit(False)
    for c in OTHER_BLANKS:
        blanks |= F.contains(F.col("line"), F.lit(c))
    words = F.array_remove(F.when(blanks, F.split(folded, GAP)).otherwise(F.split(folded, " ")), "")
    enough = F.filter(F.array(words), lambda w: F.size(w) >= least)
    return rows.select("doc_id", "line_no", F.explode(F.transform(enough, make)).alias("made"))


def rarity(docs: DataFrame) -> Column:
    """Array literal: the rarity class (four per doubling) of each bucket of token hashes, counted over all lines."""
    tokens = each_line(lines_of(docs), _pairs, MIN_WORDS).select(F.explode("made").alias("t"))
    counts = tokens.groupBy(F.pmod("t", F.lit(BUCKETS)).cast("int").alias("b")).agg(F.count("*").alias("n"))
    classes = ["0"] * BUCKETS
    for row in counts.select("b", F.floor(F.log2("n") * 4).cast("int").alias("c")).toLocalIterator():
        classes[row["b"]] = str(row["c"])
    return F.split(F.lit(",".join(classes)), ",").cast("array<int>")


def _token_sets(rows: DataFrame, classes: Column, least: int = 1) -> DataFrame:
    """(doc_id, line_no, tokens) of lines with ``least`` words: distinct tokens, rarest first: class above, 54 bits of hash below.

    The one token of a line of under MIN_WORDS words is written as null, null and the two halves of a digest of its words.
    """

    def ranked(t: Column) -> Column:
        return F.shiftleft(F.get(classes, F.pmod(t, F.lit(BUCKETS)).cast("int")).cast("long"), 54) + t.bitwiseAND((1 << 54) - 1)

    def made(w: Column) -> Column:
        tokens = F.sort_array(F.array_distinct(F.transform(_pairs(w), ranked)))
        none = F.lit(None).cast("long")
        return F.when(F.size(w) >= MIN_WORDS, tokens).otherwise(F.array(none, none, F.xxhash64(w), F.xxhash64(F.lit(7), w)))

    return each_line(rows, made, least).withColumnRenamed("made", "tokens")


def _required(n: Column, m: Column) -> Column:
    """Smallest overlap of sets of n and m tokens at the threshold."""
    return F.ceil((n + m) * THRESHOLD / F.lit(100.0 + THRESHOLD) - 1e-9)


def _may_match(n: Column, i: Column, x: Column, m: Column, j: Column, y: Column) -> Column:
    """Length, positional and parity filter for sets of n and m tokens whose first common token is at i and j.

    x and y tell, for 64 classes of tokens, whether the set has an odd number of them: each class in which they
    differ holds a token of one set alone. All three hold for every pair that reaches the threshold.
    """
    apart = n + m - 2 * _required(n, m)
    return (F.least(n, m) * 100 >= F.greatest(n, m) * THRESHOLD) & (F.least(n - i, m - j) >= _required(n, m)) & (F.bit_count(x.bitwiseXOR(y)) <= apart)


def _sets_for(docs: DataFrame, lines: DataFrame, classes: Column) -> DataFrame:
    """(doc_id, line_no, tokens) of the given lines, read again from the texts; no other line is split into words."""
    lines = stored(lines.groupBy("doc_id").agg(F.collect_set("line_no").alias("wanted")), "wanted-lines")
    texts = docs.filter("text is not null").select("doc_id", "text").join(F.broadcast(lines) if lines.count() <= WANTED else lines, "doc_id")
    numbered = F.filter(F.transform(F.split("text", "\n"), lambda x, i: F.struct(i.alias("line_no"), x.alias("line"))), lambda r: F.array_contains("wanted", r["line_no"]))
    rows = texts.select("doc_id", F.explode(numbered).alias("r")).select("doc_id", "r.line_no", "r.line")
    return stored(_token_sets(rows, classes, MIN_WORDS), "line-sets")


def _verified(docs: DataFrame, pairs: DataFrame, classes: Column) -> DataFrame:
    """(doc_id, line_no) that really match an earlier line of ``pairs`` (doc_id, line_no, e_doc, e_line)."""
    pairs = stored(pairs.distinct(), "line-pairs")
    wanted = pairs.select("doc_id", "line_no").unionByName(pairs.select(F.col("e_doc").alias("doc_id"), F.col("e_line").alias("line_no"))).distinct()
    sets = _sets_for(docs, wanted, classes)
    earlier = sets.select(F.col("doc_id").alias("e_doc"), F.col("line_no").alias("e_line"), F.col("tokens").alias("e_tokens"))
    both = F.size(F.array_intersect("tokens", "e_tokens"))
    union = F.size("tokens") + F.size("e_tokens") - both
    return (
        pairs.join(sets, ["doc_id", "line_no"])
        .join(earlier, ["e_doc", "e_line"])
        .filter(both * 100 >= union * THRESHOLD)
        .select("doc_id", "line_no")
        .distinct()
    )


def removed_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, near) of every line that an earlier one makes superfluous; near: no equal set came before.

    Short lines match equal ones alone, so they meet in the grouping of equal sets and have no prefix.
    Equal sets are one, represented by their first line. Tokens that only one set has in its prefix drop out.
    Each set first meets the earliest set that shares a prefix token, which is linear in any group of copies; only
    sets that found no match that way meet all earlier ones that share a token.
    """
    classes = rarity(docs)
    lines = _token_sets(lines_of(docs), classes)
    n = F.size("tokens")
    prefix = F.slice("tokens", 1, (n - F.ceil(n * THRESHOLD / F.lit(100.0) - 1e-9) + 1).cast("int"))
    parity = F.aggregate("tokens", F.lit(0).cast("long"), lambda acc, t: acc.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(t, F.lit(64)).cast("int"))))
    lines = lines.select("doc_id", "line_no", F.xxhash64("tokens").alias("a"), F.xxhash64(F.lit(7), "tokens").alias("b"), n.alias("n"), parity.alias("parity"), F.when(F.col("tokens")[0].isNotNull(), prefix).otherwise(F.array().cast("array<bigint>")).alias("prefix"))
    first = lines.groupBy("a", "b").agg(F.min(F.struct("doc_id", "line_no", "n", "parity", "prefix")).alias("s"))
    first = stored(first.select("s.*"), "first-lines")

    postings = first.select("doc_id", "line_no", "n", "parity", F.posexplode("prefix").alias("at", "token"))
    # one exchange serves the count and the join
    postings = postings.repartition("token")
    crowd = postings.groupBy("token").agg(F.count("*").alias("_c")).filter("_c > 1").drop("_c")
    postings = stored(postings.join(crowd, "token"), "postings")

    lead = postings.groupBy("token").agg(F.min(F.struct("doc_id", "line_no", "n", "at", "parity")).alias("e"))
    own = F.struct("doc_id", "line_no")
    met = postings.join(lead, "token").filter((own > F.struct("e.doc_id", "e.line_no")) & _may_match(F.col("n"), F.col("at"), F.col("parity"), F.col("e.n"), F.col("e.at"), F.col("e.parity")))
    near = stored(_verified(docs, met.select("doc_id", "line_no", F.col("e.doc_id").alias("e_doc"), F.col("e.line_no").alias("e_line")), classes), "near-lead")

    rest = postings.join(near, ["doc_id", "line_no"], "left_anti")
    leads = lead.select("token", F.col("e.doc_id").alias("l_doc"), F.col("e.line_no").alias("l_line"))
    earlier = postings.select("token", F.col("doc_id").alias("e_doc"), F.col("line_no").alias("e_line"), F.col("n").alias("e_n"), F.col("at").alias("e_at"), F.col("parity").alias("e_parity"))
    earlier = earlier.join(leads, "token").filter("e_doc <> l_doc or e_line <> l_line").drop("l_doc", "l_line")
    met = rest.join(earlier, "token").filter((own > F.struct("e_doc", "e_line")) & _may_match(F.col("n"), F.col("at"), F.col("parity"), F.col("e_n"), F.col("e_at"), F.col("e_parity")))
    near = near.unionByName(_verified(docs, met.select("doc_id", "line_no", "e_doc", "e_line"), classes))

    kept = first.select("doc_id", "line_no").join(near, ["doc_id", "line_no"], "left_anti")
    kept = kept.groupBy("doc_id").agg(F.collect_set("line_no").alias("kept"))
    near = near.groupBy("doc_id").agg(F.collect_set("line_no").alias("near"))
    # the longest list is one document's lines
    seen = docs.filter("text is not null and doc_id is not null").select(
        "doc_id",
        F.filter(
            F.transform(F.split("text", "\n"), lambda x, i: F.when(x.rlike(r"[^\x20\x09-\x0D]"), i)),
            lambda i: i.isNotNull(),
        ).alias("seen"),
    )
    none = F.array().cast("array<int>")
    rows = seen.join(kept, "doc_id", "left").join(near, "doc_id", "left")
    near_here = F.coalesce("near", none)
    return rows.select("doc_id", F.explode(F.array_except("seen", F.coalesce("kept", none))).alias("line_no"), near_here.alias("_near")).select(
        "doc_id", "line_no", F.array_contains("_near", F.col("line_no")).alias("near")
    )


def line_report(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_lines, n_repeated and n_near (removed lines), and the removed line numbers.

    Null text has no lines, empty text one. Documents without an id keep all lines and remove none elsewhere.
    Rows that repeat an id share one list of removed lines; a repeated row's equal lines stay in both. Texts may
    be of any length: lines, not documents, are compared. An empty table gives no rows. Other columns are not read.
    """
    gone = removed_lines(docs).distinct().groupBy("doc_id").agg(
        F.count(F.when(~F.col("near"), 1)).alias("n_repeated"),
        F.count(F.when(F.col("near"), 1)).alias("n_near"),
        F.array_sort(F.collect_list("line_no")).alias("removed"),
    )
    rows = docs.select("doc_id", F.coalesce(F.size(F.split("text", "\n")), F.lit(0)).alias("n_lines"))
    rows = rows.withColumn("n_lines", F.greatest("n_lines", F.lit(0)).cast("long"))
    return rows.join(gone, "doc_id", "left").select(
        "doc_id",
        "n_lines",
        F.coalesce("n_repeated", F.lit(0)).alias("n_repeated"),
        F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.coalesce("removed", F.array().cast("array<int>")).alias("removed"),
    )


def drop_lines(docs: DataFrame) -> DataFrame:
    """The documents with superfluous lines taken out of ``text``, and n_chars, where there is one, set anew.

    A document of which nothing but blank lines is left goes; one that had no words from the start stays. Documents
    without an id keep all lines.
    """
    gone = removed_lines(docs).groupBy("doc_id").agg(F.collect_set("line_no").alias("_gone")).withColumnRenamed("doc_id", "_id")
    kept = F.filter(F.transform(F.split("text", "\n"), lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda s: ~F.array_contains("_gone", s["i"]))
    text = F.when(F.col("_gone").isNull(), F.col("text")).otherwise(F.array_join(F.transform(kept, lambda s: s["x"]), "\n"))
    rows = docs.join(gone, docs["doc_id"] == gone["_id"], "left").withColumn("text", text)
    rows = rows.filter("_gone is null or text rlike '[^\\\\x20\\\\x09-\\\\x0D]'")
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(F.col("_gone").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return rows.select(*docs.columns)


def op2_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_report(documents(spark, sf_dir))


OP2_SQL = rf"""
WITH split AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no
  FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL),
worded AS (
  SELECT doc_id, line_no, regexp_extract_all(translate(line, '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM split),
sets AS (
  SELECT doc_id, line_no, CASE WHEN len(w) < {MIN_WORDS} THEN ['whole line: ' || array_to_string(w, ' ')]
    ELSE list_sort(list_distinct(list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1]))) END AS s
  FROM worded WHERE len(w) > 0),
classes AS (SELECT s, min((doc_id, line_no)) AS first, row_number() OVER () AS k, len(s) AS n FROM sets GROUP BY s),
tokens AS (SELECT k, n, first, unnest(s) AS t FROM classes),
near AS (
  SELECT DISTINCT k FROM (
    SELECT x.k, y.k AS e, count(*) AS shared, any_value(x.n + y.n) AS total
    FROM tokens x JOIN tokens y ON x.t = y.t AND y.first < x.first
      AND least(x.n, y.n) * 100 >= greatest(x.n, y.n) * {THRESHOLD}
    GROUP BY x.k, y.k)
  WHERE shared * 100 >= (total - shared) * {THRESHOLD}),
gone AS (
  SELECT l.doc_id, l.line_no, ((l.doc_id, l.line_no) = c.first) AS near
  FROM sets l JOIN classes c USING (s) LEFT JOIN near n USING (k)
  WHERE (l.doc_id, l.line_no) <> c.first OR n.k IS NOT NULL),
counted AS (
  SELECT doc_id, count(*) FILTER (NOT near) AS n_repeated, count(*) FILTER (near) AS n_near,
         list(line_no::INT ORDER BY line_no) AS removed FROM gone GROUP BY doc_id)
SELECT d.doc_id, coalesce(len(string_split(d.text, chr(10))), 0)::BIGINT AS n_lines,
       coalesce(n_repeated, 0)::BIGINT AS n_repeated, coalesce(n_near, 0)::BIGINT AS n_near, coalesce(removed, []::INT[]) AS removed
FROM documents d LEFT JOIN counted USING (doc_id)
"""
