"""Document fingerprints by SpotSigs, with DataFrame functions only.

Common words are anchors; the chain of the next CHAIN content words after an anchor (further anchors skipped,
fewer words at the text's end) is a signature. Punctuation, line ends and the beginning of a text count as
anchors too, so lists and titles without common words have signatures, and each text with a content word has
one; a text without any has its own hash as its only signature. A document is the
set of its signatures' hashes, its fingerprint the set's size with a hash of the sorted set. The likeness of
two documents is the Jaccard similarity of their sets.

Near duplicates are found among different sets: sets are partitioned by length, so that only sets of the same
or the next partition can be alike enough; candidates share a signature of their prefixes (rarest order is
by hash), and a pair whose lengths alone rule out the likeness is pruned before sets are intersected.

Defined results: a null text is empty; equal texts, empty ones too, have equal fingerprints and likeness 1;
documents with the same doc_id follow each other by text; a null doc_id comes last; a single document is its
own next one; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textmill.llm.common import let

#: Common words of English, German, French and Spanish. Fixed values.
ANCHORS = (
    "a an and are as at be by for from in is it of on or that the this to was were with "
    "das dem den der des die ein eine einer er es für ich im ist mit nicht sich sie und von war zu "
    "au aux avec ce dans de du elle en est et il la le les ne par pas pour que qui se sur un une "
    "al como con del el ella los las lo más no para pero por su una y"
).split()
CHAIN, LEAST = 3, 0.8
MARK = "\x01"


def marked(text: Column) -> Column:
    """Words in lower case, each after a space, with runs of anchors as one mark; the text's start, punctuation and line ends are marks."""
    words = F.regexp_replace(F.lower(text), r"[^\p{L}\p{N} ][^\p{L}\p{N}]*", f" {MARK} ")
    spaced = F.regexp_replace(F.concat(F.lit(" "), words, F.lit(" ")), " {2,}", " ")
    anchors = F.regexp_replace(spaced, f" (?:{'|'.join(sorted(set(ANCHORS)))})(?= )", f" {MARK}")
    return F.regexp_replace(F.concat(F.lit(f" {MARK}"), anchors), f"(?: {MARK})++", f" {MARK}")


def digest(text: Column) -> Column:
    """60 bits of the MD5 of a string, a hash that other engines have too."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def signatures(text: Column, chain: int = CHAIN) -> Column:
    """The set of signature hashes of a text."""
    pattern = f"{MARK}(?=((?:(?: {MARK})? +[^ {MARK}]+){{1,{chain}}}))"
    found = F.regexp_extract_all(marked(text), F.lit(pattern), F.lit(1))
    hashes = F.array_distinct(F.transform(found, lambda m: digest(F.trim(F.regexp_replace(m, f"[ {MARK}]+", " ")))))
    return let(hashes, lambda h: F.when(F.size(h) > 0, h).otherwise(F.array(digest(text))))


def fingerprint(sigs: Column) -> Column:
    return F.concat_ws("-", F.size(sigs).cast("string"), F.left(F.md5(F.array_join(F.transform(F.array_sort(sigs), lambda x: x.cast("string")), ",").cast("binary")), F.lit(16)))


def likeness(a: Column, b: Column, least: float = 0.0) -> Column:
    """Jaccard similarity of two sets; 0 without comparing them where their lengths allow less than least."""
    small, large = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    shared = F.size(F.array_intersect(a, b)).cast("double")
    return F.when(small < large * least, F.lit(0.0)).otherwise(shared / (F.size(a) + F.size(b) - shared))


def bounds(ids: DataFrame, parts: int) -> list[list[int]]:
    """Range bounds of doc_id, about parts of them, in groups of about their root (two short searches for each row)."""
    found = ids.agg(F.percentile_approx("doc_id", [k / parts for k in range(1, parts)], 10 * parts)).first()[0] if parts > 1 else None
    flat = sorted(set(found or []))
    step = max(1, math.isqrt(len(flat)))
    return [flat[k : k + step] for k in range(0, len(flat), step)]


def bucket_of(doc_id: Column, groups: list[list[int]]) -> Column:
    """The number of bounds at or below doc_id; a null doc_id is below all."""
    if not groups:
        return F.lit(0)
    firsts = "array(" + ",".join(f"{g[0]}L" for g in groups) + ")"
    nested = "array(" + ",".join("array(" + ",".join(f"{x}L" for x in g) + ")" for g in groups) + ")"
    step = len(groups[0])
    return F.expr(f"transform(array(doc_id), d -> coalesce(transform(array(size(filter({firsts}, x -> x <= d))), g -> if(g = 0, 0, (g - 1) * {step} + size(filter(element_at({nested}, g), x -> x <= d))))[0], 0))[0]")


def with_next(docs: DataFrame, **columns: Column) -> DataFrame:
    """docs(doc_id, text) by descending doc_id with next_text, and for each of columns its value and next_ value.

    Texts are dealt once, by ranges of doc_id; the document after a range's last is the first of the next
    range that has any, found from one row per range.
    """
    parts = max(1, 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    docs = docs.withColumn("bucket", bucket_of(F.col("doc_id"), bounds(docs.select("doc_id"), parts)))
    w = Window.partitionBy("bucket").orderBy(F.col("doc_id").desc_nulls_last(), "text")
    d = docs.withColumns({"rn": F.row_number().over(w), "next_text": F.lead("text").over(w)})
    for name, column in columns.items():
        d = d.select("*", F.explode(F.array(column)).alias(name))
    firsts = d.where("rn = 1").select(F.col("bucket").alias("of"), F.col("text").alias("first_text"), *[F.col(c).alias(f"first_{c}") for c in columns])
    # One number per range: which range follows.
    ranges = docs.select("bucket").distinct()
    order = Window.orderBy(F.col("bucket").desc())
    follows = ranges.select("bucket", F.coalesce(F.lead("bucket").over(order), F.max("bucket").over(Window.partitionBy())).alias("of"))
    tail = follows.join(firsts, "of").drop("of")
    d = d.withColumns({f"next_{c}": F.lead(c).over(w) for c in columns})
    d = d.withColumn("last", F.lead(F.lit(1)).over(w).isNull())
    d = d.join(tail.withColumnRenamed("bucket", "b"), F.col("last") & (F.col("bucket") == F.col("b")), "left")
    return d.withColumns({f"next_{c}": F.when(F.col("last"), F.col(f"first_{c}")).otherwise(F.col(f"next_{c}")) for c in ["text", *columns]})


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of all texts and of their edited texts (the last third replaced by the start of the next document)."""
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    d = with_next(d, sigs=signatures(F.col("text")))
    k = F.floor(F.length("text") / 3).cast("int")
    d = d.withColumn("edited", F.concat(F.substr("text", F.lit(1), F.length("text") - k), F.substr("next_text", F.lit(1), k)))
    # A generator of one row: what uses the set below shares it instead of computing it again.
    kept = ["doc_id", "text", "edited", "sigs", "next_sigs"]
    d = d.select(*kept, F.explode(F.array(signatures(F.col("edited")))).alias("edited_sigs"))
    return d.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprint(F.col("sigs")).alias("fingerprint"), fingerprint(F.col("edited_sigs")).alias("edited_fingerprint"),
        likeness(F.col("sigs"), F.col("edited_sigs")).alias("near_edited"), likeness(F.col("sigs"), F.col("next_sigs")).alias("near_next"),
    )


def near_duplicates(docs: DataFrame, least: float = LEAST) -> tuple[DataFrame, DataFrame]:
    """Classes of equal sets and pairs of classes that are alike.

    classes: doc_id, class_id (smallest doc_id with the same set); pairs: a < b (class ids), likeness >= least.
    """
    d = docs.select("doc_id", signatures(F.coalesce("text", F.lit(""))).alias("sigs")).withColumn("fp", fingerprint(F.col("sigs")))
    sets = d.groupBy("fp").agg(F.min("doc_id").alias("class_id"), F.any_value("sigs").alias("sigs"))
    classes = d.select("doc_id", "fp").join(sets.select("fp", "class_id"), "fp").select("doc_id", "class_id")
    n = F.size("sigs")
    s = sets.select("class_id", "sigs", n.alias("n"), F.floor(F.log(n.cast("double")) / math.log(1 / least)).cast("int").alias("part"))
    prefix = F.slice(F.array_sort("sigs"), F.lit(1), (F.col("n") - F.ceil(F.col("n") * least - 1e-9) + 1).cast("int"))
    s = s.withColumn("sig", F.explode(prefix))
    # A set meets its own partition and the next one, where sets of up to n / least signatures are.
    right = s.select(F.col("class_id").alias("b"), F.col("n").alias("m"), F.col("part").alias("p"), "sig", F.explode(F.array("part", F.col("part") - 1)).alias("of"))
    c = s.select(F.col("class_id").alias("a"), "n", "part", "sig").join(right, "sig").where("part = of AND a <> b AND (part < p OR a < b) AND least(n, m) >= greatest(n, m) * " + str(least - 1e-9))
    c = c.select("a", "b").distinct()
    sides = [sets.select(F.col("class_id").alias(x), F.col("sigs").alias(f"sigs_{x}")) for x in "ab"]
    c = c.join(sides[0], "a").join(sides[1], "b").withColumn("likeness", likeness(F.col("sigs_a"), F.col("sigs_b"), least - 1e-9))
    pairs = c.where(F.col("likeness") >= least - 1e-12).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "likeness")
    return classes, pairs


def op2_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_edits(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def oracle() -> str:
    """SQL for the rows of op2_spotsigs: tokens numbered, content words before each anchor counted, chains cut from their list."""
    anchors = ", ".join(f"'{a}'" for a in sorted(set(ANCHORS)))
    h = "CAST('0x' || substr(md5({}), 1, 15) AS BIGINT)"
    return f"""
WITH o AS (SELECT doc_id, coalesce(text, '') AS text, lead(coalesce(text, '')) OVER (ORDER BY doc_id DESC NULLS LAST, coalesce(text, '')) AS nx,
  first_value(coalesce(text, '')) OVER (ORDER BY doc_id DESC NULLS LAST, coalesce(text, '')) AS fx FROM documents),
e AS (SELECT doc_id, text, coalesce(nx, fx) AS nt, left(text, length(text) - length(text) // 3) || left(coalesce(nx, fx), length(text) // 3) AS edited FROM o),
v AS (SELECT doc_id, 'a' AS v, text AS t FROM e UNION ALL SELECT doc_id, 'b', edited FROM e UNION ALL SELECT doc_id, 'c', nt FROM e),
k AS (SELECT doc_id, v, regexp_extract_all(lower(t), '[\\pL\\pN]+|[^\\pL\\pN ][^\\pL\\pN]*') AS w FROM v),
x AS (SELECT doc_id, v, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM k),
y AS (SELECT *, regexp_matches(w, '^[\\pL\\pN]') AND w NOT IN ({anchors}) AS c FROM x),
z AS (SELECT *, sum(CAST(c AS INT)) OVER (PARTITION BY doc_id, v ORDER BY i) AS n FROM y),
cw AS (SELECT doc_id, v, list(w ORDER BY i) AS words FROM z WHERE c GROUP BY doc_id, v),
st AS (SELECT doc_id, v, n FROM z WHERE NOT c UNION SELECT doc_id, v, 0 FROM cw),
sg AS (SELECT doc_id, v, {h.format("array_to_string(words[n + 1:n + " + str(CHAIN) + "], ' ')")} AS h FROM st JOIN cw USING (doc_id, v) WHERE n < len(words)),
ls AS (SELECT doc_id, v, list_sort(list(DISTINCT h)) AS s FROM sg GROUP BY doc_id, v),
f AS (SELECT doc_id, v, coalesce(s, [{h.format("t")}]) AS s FROM v LEFT JOIN ls USING (doc_id, v)),
j AS (SELECT a.doc_id, a.s AS a, b.s AS b, c.s AS c FROM f a JOIN f b ON a.doc_id = b.doc_id AND a.v = 'a' AND b.v = 'b' JOIN f c ON a.doc_id = c.doc_id AND c.v = 'c')
SELECT doc_id, length(text) AS n_chars, sha256(edited) AS edited_sha256,
  CAST(len(a) AS VARCHAR) || '-' || left(md5(array_to_string(a, ',')), 16) AS fingerprint, CAST(len(b) AS VARCHAR) || '-' || left(md5(array_to_string(b, ',')), 16) AS edited_fingerprint,
  CAST(len(list_intersect(a, b)) AS DOUBLE) / (len(a) + len(b) - len(list_intersect(a, b))) AS near_edited,
  CAST(len(list_intersect(a, c)) AS DOUBLE) / (len(a) + len(c) - len(list_intersect(a, c))) AS near_next
FROM e JOIN j USING (doc_id)"""
