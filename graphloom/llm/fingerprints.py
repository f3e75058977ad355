"""Document fingerprints by I-Match over randomised lexicons, in DataFrame functions only.

The lexicon holds the terms (runs of letters and digits, lower case) that occur in at
least 1/RARE and at most 1/COMMON of all documents: a band of inverse document
frequency.  It has at most RARE times the mean number of distinct terms of a document,
whatever the number of documents; it is broadcast up to BROADCAST terms and merged
beyond.  A document's distinct terms in the band are sorted by hash.  There are DRAWS
random sublexicons of each share in SHARES (1/4 to 1/4096 of the band); for each, all of
the document's terms that it keeps are hashed together, and the fingerprint is the list
of these hashes.  No term is left out for the length of a text: every document is
fingerprinted by all sublexicons, and large shares tell short texts apart as small ones
do long texts.  Likeness is the share of equal hashes among the sublexicons that either
text uses, at the share of the lexicon where it is greatest (and LEAST are used): a
quarter of a text changed breaks every sublexicon of a large share.

Terms that a large group of near copies shares lie above the band, and what is left are
the words in which the copies differ.  So every text has a second fingerprint, made in the
same way of all its terms; it counts where either text is thin: fewer than FEW of its
terms, or less than a quarter of them, lie in the band.

Cases: a null text is the empty text; texts of the same terms are alike (1), be it none;
equal texts always have equal fingerprints; repeated ids are ordered by text, and whole
equal rows are alike in any order; texts of any length are read whole; a single document
is its own next one; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

RARE = 2000
COMMON = 12
#: Bits of a term's hash that must be 0 for a sublexicon to keep it: shares of 1/4, 1/16, ... 1/4096.
SHARES = (2, 4, 6, 8, 10, 12)
#: Sublexicons of each share; each looks at its own window of the hash, STEP bits on.
DRAWS = 8
STEP = 7
LEAST = 3
FEW = 8
BROADCAST = 2_000_000


def term_hashes(text: Column) -> Column:
    """Distinct 64-bit hashes of a text's terms."""
    words = F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")
    return F.array_distinct(F.transform(words, lambda w: F.xxhash64(w)))


def lexicon(docs: DataFrame, n_docs: int, rare: int = RARE, common: int = COMMON) -> DataFrame:
    """(term) of the band."""
    df = docs.select(F.explode(term_hashes(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    return df.where((F.col("df") >= max(2, n_docs / rare)) & (F.col("df") <= max(2, n_docs / common))).select("term")


def _fingerprint(df: DataFrame, terms: str, name: str) -> DataFrame:
    """df with a column `name`: the hashes of what each sublexicon keeps of the column of sorted terms, null for nothing.

    Each projection reads what the one before it kept, as a smaller share of one window is part of the larger ones.
    """
    rest, done = df.columns, []
    window = lambda a, k, bits: F.filter(a, lambda h: F.call_function("shiftrightunsigned", h, STEP * k).bitwiseAND(F.lit((1 << bits) - 1).cast("long")) == F.lit(0).cast("long"))
    hashed = lambda i: F.transform(f"__{i}", lambda a: F.when(F.size(a) > 0, F.hash(a))).alias(f"__h{i}")
    for i, bits in enumerate(SHARES):
        if i == 0:
            made = F.transform(F.sequence(F.lit(0), F.lit(DRAWS - 1)), lambda k: window(F.col(terms), k, bits))
        else:
            made = F.transform(f"__{i - 1}", lambda a, k: window(a, k, bits))
        df = df.select(*rest, *done, *([hashed(i - 1)] if i else []), made.alias(f"__{i}"))
        done += [f"__h{i - 1}"] if i else []
    return df.select(*rest, F.concat(*done, hashed(len(SHARES) - 1)).alias(name))


def likeness(a: Column, b: Column) -> Column:
    """a, b: bare (hash of all terms), thin, and two fingerprints, band and full."""

    def share(x: Column, y: Column) -> Column:
        marks = F.zip_with(x, y, lambda p, q: F.when(p == q, 2).when(p.isNotNull() | q.isNotNull(), 1).otherwise(0))
        return F.aggregate(F.sequence(F.lit(0), F.lit(len(SHARES) - 1)), F.lit(0.0), lambda best, i: F.greatest(best, of(F.slice(marks, i * DRAWS + 1, DRAWS))))

    def of(part: Column) -> Column:
        used = F.size(F.filter(part, lambda m: m > 0))
        return F.when(used >= LEAST, F.size(F.filter(part, lambda m: m == 2)) / used).otherwise(0.0)

    return F.when(a["bare"] == b["bare"], 1.0).when(a["thin"] | b["thin"], share(a["full"], b["full"])).otherwise(share(a["band"], b["band"]))


def _text(f: Column) -> Column:
    hexes = lambda c: F.array_join(F.transform(c, lambda h: F.lpad(F.hex(h.cast("long").bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))), 8, "0")), ".", "-")
    return F.when(f["thin"], F.concat(F.lit("a:"), hexes(f["full"]))).otherwise(hexes(f["band"]))


def _bucket(doc_id: Column, bounds: list[int]) -> Column:
    """How many of the sorted bounds are at most doc_id, by binary search."""
    depth = max(1, math.ceil(math.log2(len(bounds) + 1)))
    padded = F.array(*(F.lit(int(b)).cast("long") for b in bounds)) if bounds else F.array().cast("array<bigint>")
    steps = F.array(*(F.lit(1 << k) for k in range(depth - 1, -1, -1)))
    return F.aggregate(steps, F.lit(0), lambda at, s: F.when((at + s <= len(bounds)) & (F.get(padded, at + s - 1) <= doc_id), at + s).otherwise(at))


def document_fingerprints(docs: DataFrame, rare: int = RARE, common: int = COMMON) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next).

    The edited text has its last floor(n_chars / 4) code points replaced by the first
    as many of the next document by doc_id.  Neighbours are found without a global
    sort: quantiles of doc_id deal the rows to buckets, one shuffle in all, and each
    bucket gets a guest copy of the first rows of the next one.
    """
    spark = docs.sparkSession
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).where("doc_id is not null")
    want = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    head = base.agg(F.count("*").alias("n"), F.percentile_approx("doc_id", [(k + 1) / want for k in range(want - 1)], 20 * want).alias("q")).first()
    bounds = sorted(set(head["q"] or []))
    placed = base.withColumn("bucket", _bucket(F.col("doc_id"), bounds))
    firsts = sorted((r["bucket"], r["first"]) for r in base.select("doc_id").withColumn("bucket", _bucket(F.col("doc_id"), bounds)).groupBy("bucket").agg(F.min("doc_id").alias("first")).collect())  # a row for each bucket
    guests = spark.createDataFrame([(firsts[(k + 1) % len(firsts)][1], b) for k, (b, _) in enumerate(firsts)], "doc_id long, bucket int")
    hosted = base.join(F.broadcast(guests), "doc_id").select("doc_id", "text", "bucket", F.lit(True).alias("guest"))
    rows = placed.withColumn("guest", F.lit(False)).select("doc_id", "text", "bucket", "guest").unionByName(hosted)
    order = Window.partitionBy("bucket").orderBy("guest", "doc_id", "text")
    n = F.length("text")
    q = F.floor(n / 4).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), n - q), F.substr(F.coalesce("following", F.lit("")), F.lit(1), q))
    pairs = rows.select("bucket", "guest", "doc_id", "text", F.row_number().over(order).alias("place"), F.lead("text").over(order).alias("following"))
    texts = pairs.select("bucket", "place", "guest", "doc_id", n.cast("long").alias("n_chars"), "text", edited.alias("edited"))
    termed = texts.select(
        "bucket", "place", "guest", "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), term_hashes(F.col("text")).alias("own"), term_hashes(F.col("edited")).alias("new"),
    )
    bare = lambda c: F.xxhash64(F.array_sort(c))
    head_keys = ["bucket", "place", "guest", "doc_id", "n_chars", "edited_sha256"]
    termed = termed.select(*head_keys, *(F.array_sort(c).alias(c) for c in ("own", "new")))
    for c in ("own", "new"):
        termed = _fingerprint(termed, c, f"{c}_full")
    keys = [*head_keys[2:], *(f"{c}_{n}" for c in ("own", "new") for n in ("bare", "size", "full"))]
    termed = termed.select(*head_keys, *(f(c).alias(f"{c}_{n}") for c in ("own", "new") for n, f in (("bare", bare), ("size", F.size))), "own_full", "new_full", "own", "new")
    # what belongs to the text goes with one row of it, not with each of its terms
    head_row = F.array(F.struct(F.lit(None).cast("long").alias("term"), F.lit(-1).alias("side"), F.struct(*keys).alias("rest")))
    none = F.lit(None).cast(termed.select(F.struct(*keys).alias("rest")).schema["rest"].dataType)
    tag = lambda c, k: F.transform(c, lambda h: F.struct(h.alias("term"), F.lit(k).alias("side"), none.alias("rest")))
    single = termed.select("bucket", "place", F.explode(F.concat(head_row, tag("own", 0), tag("new", 1))).alias("t")).select("bucket", "place", "t.term", "t.side", "t.rest")
    band = materialize(lexicon(base, head["n"], rare, common), "lexicon")
    band = band.hint("broadcast" if band.count() <= BROADCAST else "merge").withColumn("in_band", F.lit(True))
    found = single.join(band, "term", "left")
    side = lambda k: F.array_sort(F.collect_list(F.when((F.col("side") == k) & F.col("in_band"), F.col("term"))))
    lists = found.groupBy("bucket", "place").agg(F.first("rest", ignorenulls=True).alias("rest"), side(0).alias("own"), side(1).alias("new")).select("bucket", "place", "rest.*", "own", "new")
    thin = lambda c: (F.size(c) < F.greatest(F.lit(FEW), F.col(f"{c}_size") / 4)).alias(f"{c}_thin")
    marked = lists.select("*", thin("own"), thin("new"))
    for c in ("own", "new"):
        marked = _fingerprint(marked, c, f"{c}_band")
    whole = lambda c: F.struct(*(F.col(f"{c}_{n}").alias(n) for n in ("bare", "thin", "band", "full")))
    marked = marked.select("bucket", "place", "guest", "doc_id", "n_chars", "edited_sha256", whole("own").alias("fp"), whole("new").alias("efp"))
    near = likeness(F.col("fp"), F.col("efp")).cast("double")
    marked = marked.select("bucket", "place", "guest", "doc_id", "n_chars", "edited_sha256", "fp", _text(F.col("efp")).alias("edited_fingerprint"), near.alias("near_edited"))
    last = marked.withColumn("nfp", F.lead("fp").over(Window.partitionBy("bucket").orderBy("place"))).where("not guest")
    near_next = likeness(F.col("fp"), F.col("nfp")).cast("double")
    return last.select("doc_id", "n_chars", "edited_sha256", _text(F.col("fp")).alias("fingerprint"), "edited_fingerprint", "near_edited", near_next.alias("near_next"))
