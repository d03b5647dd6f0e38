"""Texts: tokens, vocabularies and co-occurrences, key-collision clusters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars, udf
from ..functions.values import Val
from ..storage import durable, few, scratch

#: Kinds of tokens and their patterns, tried in this order.
KINDS = (
    ("url", r"https?://[^\s<>\"]+|www\.[^\s<>\"]+"), ("email", r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+"), ("hashtag", r"#[\p{L}\p{N}_]+"), ("mention", r"@[\p{L}\p{N}_]+"),
    ("number", r"-?\d+(?:[.,]\d+)*"), ("word", r"[\p{L}\p{M}\p{N}]+(?:['’][\p{L}\p{M}]+)?(?:-[\p{L}\p{M}\p{N}]+)*"), ("emoji", r"[\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}]"), ("punct", r"[^\s\p{L}\p{N}]"),
)
SIMPLE = r"[\p{L}\p{N}]+"
#: What the kinds' patterns find, with less backtracking: letters alone, which nothing continues, are a word, and runs give nothing back.
LETTERS = r"\p{L}++(?![\p{L}\p{M}\p{N}\w.+@'’:/-])"
FAST = {
    "url": r"https?://[^\s<>\"]++|www\.[^\s<>\"]++", "email": r"[\w.+-]++@[\w-]++(?:\.[\w-]++)++", "hashtag": r"#[\p{L}\p{N}_]++", "mention": r"@[\p{L}\p{N}_]++",
    "number": r"-?\d++(?:[.,]\d++)*+", "word": r"[\p{L}\p{M}\p{N}]++(?:['’][\p{L}\p{M}]++)?+(?:-[\p{L}\p{M}\p{N}]++)*+",
}


def token_array(cell: Column, simple: bool = False, kinds: list[str] | None = None, lower: bool = False, unidecode: bool = False, stemmer: str | None = None, min_length: int | None = None, max_length: int | None = None, stoplist: list[str] | None = None, split_hyphens: bool = False, ngrams: tuple[int, int] | None = None, junk: bool = False, unique: bool = False) -> Column:
    """The tokens of a text, by regular expressions: stages in the order of the arguments that name them."""
    text = F.coalesce(cell.cast("string"), F.lit(""))
    if split_hyphens:
        text = F.translate(text, "-", " ")
    pattern = SIMPLE if simple else f"(?:{LETTERS}|" + "|".join(f"(?:{FAST.get(k, p)})" for k, p in KINDS) + ")"
    out = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    if kinds:
        out = F.filter(out, lambda t: token_kind(t).isin(kinds))
    if min_length:
        out = F.filter(out, lambda t: F.length(t) >= min_length)
    if max_length:
        out = F.filter(out, lambda t: F.length(t) <= max_length)
    if stoplist:
        out = F.filter(out, lambda t: ~t.isin(stoplist))
    if junk:
        out = F.filter(out, lambda t: t.rlike(r"\p{L}") & (F.length(t) > 1))
    if lower:
        out = F.transform(out, F.lower)
    if unidecode:
        out = F.split(udf.unidecode(F.array_join(out, "\u0001")), "\u0001")
    if stemmer == "s":
        out = F.transform(out, lambda t: scalars.FUNCTIONS["s_stemmer"](None, Val(t, "str")).col)
    elif stemmer:
        raise ValueError(f"no stemmer {stemmer!r}")
    if ngrams:
        a, b = ngrams
        sizes = F.sequence(F.lit(a), F.lit(b))
        place = F.sequence(F.lit(1), F.greatest(F.size(out), F.lit(1)))
        out = F.flatten(F.transform(place, lambda i: F.transform(F.filter(sizes, lambda n: i + n - 1 <= F.size(out)), lambda n: F.array_join(F.slice(out, i, n), "§"))))
    return F.array_sort(F.array_distinct(out)) if unique else out


def token_kind(token: Column) -> Column:
    out = F.when(token.rlike(r"^\p{L}++$"), "word")  # no kind before words has letters alone
    for kind, p in KINDS:
        out = out.when(token.rlike(f"^(?:{FAST.get(kind, p)})$"), kind)
    return out.otherwise("punct")


def tokenize(df: DataFrame, column: str, name: str = "tokens", rows: bool = False, sep: str = "§", types: str | None = None, keep_text: bool = False, **options) -> DataFrame:
    """Tokens joined in a cell, or a row for each; types: a column of kinds."""
    cell = F.col(f"`{column}`")
    kept = [F.col(f"`{c}`") for c in df.columns if keep_text or c != column]
    out = df.select(*kept, token_array(cell, **options).alias("_tokens"))
    if rows:
        out = out.select(*[F.col(f"`{c}`") for c in out.columns if c != "_tokens"], F.explode("_tokens").alias(name))
        return out.withColumn(types, token_kind(F.col(name))) if types else out
    joined = F.array_join("_tokens", " " if sep == "§" else sep).alias(name)
    kinds = [F.array_join(F.transform("_tokens", token_kind), " ").alias(types)] if types else []
    return out.select(*[F.col(f"`{c}`") for c in out.columns if c != "_tokens"], joined, *kinds)


def sentences(df: DataFrame, column: str, name: str = "sentence", squeeze: bool = False) -> DataFrame:
    parts = F.filter(F.transform(F.split(F.col(f"`{column}`"), r"(?<=[.!?…])\s+(?=[\p{Lu}\p{N}\"«(])|\n+"), lambda s: F.trim(F.regexp_replace(s, r"\s+", " ") if squeeze else s)), lambda s: s != "")
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c != column], F.explode(parts).alias(name))


def paragraphs(df: DataFrame, column: str, name: str = "paragraph", blank_line: bool = False) -> DataFrame:
    parts = F.filter(F.transform(F.split(F.col(f"`{column}`"), r"\n[ \t]*\n\s*" if blank_line else r"\n+"), lambda s: F.trim(s)), lambda s: s != "")
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c != column], F.explode(parts).alias(name))


def _tokens(df: DataFrame, doc: str, token: str, sep: str | None) -> DataFrame:
    items = F.explode(F.split(F.col(f"`{token}`"), f"\\Q{sep}\\E")) if sep else F.col(f"`{token}`")
    return df.select(F.col(f"`{doc}`").alias("doc"), items.alias("token")).filter("token is not null and token <> ''")


def _counts(df: DataFrame, doc: str, token: str, sep: str | None) -> DataFrame:
    return _tokens(df, doc, token, sep).groupBy("doc", "token").agg(F.count(F.lit(1)).alias("n"))


def vocab_corpus(df: DataFrame, doc: str, token: str, sep: str | None = None) -> DataFrame:
    n = _counts(df, doc, token, sep)
    return n.agg(F.count_distinct("doc").alias("doc_count"), F.sum("n").alias("token_count"), F.count_distinct("token").alias("distinct_token_count"), (F.sum("n") / F.count_distinct("doc")).alias("average_doc_len"))


def vocab_doc(df: DataFrame, doc: str, token: str, sep: str | None = None) -> DataFrame:
    return _counts(df, doc, token, sep).groupBy(F.col("doc").alias(doc)).agg(F.sum("n").alias("token_count"), F.count(F.lit(1)).alias("distinct_token_count"))


def vocab_token(df: DataFrame, doc: str, token: str, sep: str | None = None) -> DataFrame:
    """token, gf, df, df_ratio, idf, gfidf, pigeon."""
    n = _counts(df, doc, token, sep)
    docs = n.agg(F.count_distinct("doc").cast("double").alias("_N"))
    t = n.groupBy("token").agg(F.sum("n").alias("gf"), F.count(F.lit(1)).alias("df")).crossJoin(F.broadcast(docs))
    big, gf, d = F.col("_N"), F.col("gf"), F.col("df")
    pigeon = (big - big * F.pow((big - 1) / big, gf)) / d
    return t.select("token", "gf", "df", (d / big).alias("df_ratio"), F.ln(big / d).alias("idf"), (gf * big / d).alias("gfidf"), pigeon.alias("pigeon"))


def vocab_doc_token(df: DataFrame, doc: str, token: str, sep: str | None = None, k1: float = 1.2, b: float = 0.75, tf: str = "count") -> DataFrame:
    """doc, token, tf, expected_tf, tfidf, bm25, chi2. Tokens are dealt by document once, counted where they are and kept in files
    with the length of their document; a vocabulary of many tokens is joined to these, one of few is sent to all tasks."""
    spark, path = df.sparkSession, scratch(df.sparkSession, "counts")
    dealt = _tokens(df, doc, token, sep).repartition("doc").groupBy("doc", "token").agg(F.count(F.lit(1)).alias("n"))
    dealt.withColumn("dl", F.sum("n").over(Window.partitionBy("doc"))).write.parquet(path)
    n = spark.read.parquet(path)
    by_token = durable(n.groupBy("token").agg(F.sum("n").alias("gf"), F.count(F.lit(1)).alias("df")))
    by_doc = n.groupBy("doc").agg(F.first("dl").alias("dl"))
    whole = by_doc.agg(F.sum("dl").cast("double").alias("_total"), F.count(F.lit(1)).cast("double").alias("_docs"))
    j = n.filter("doc is not null").join(few(by_token), "token").crossJoin(F.broadcast(whole))
    count, dl, gf = F.col("n").cast("double"), F.col("dl").cast("double"), F.col("gf").cast("double")
    total, docs = F.col("_total"), F.col("_docs")
    idf = F.ln(docs / F.col("df"))
    weight = {"count": count, "binary": F.lit(1.0), "ratio": count / dl, "log-normal": 1 + F.ln(count)}[tf]
    bm25 = idf * count * (k1 + 1) / (count + k1 * (1 - b + b * dl / (total / docs)))
    expected = gf * dl / total
    cells = [(count, gf * dl), (gf - count, gf * (total - dl)), (dl - count, (total - gf) * dl), (total - gf - dl + count, (total - gf) * (total - dl))]
    chi2 = sum((F.when(e > 0, F.pow(o - e / total, 2) / (e / total)).otherwise(0.0) for o, e in cells), F.lit(0.0))
    return j.select(F.col("doc").alias(doc), "token", weight.alias("tf"), expected.alias("expected_tf"), (weight * idf).alias("tfidf"), bm25.alias("bm25"), F.when(count >= expected, chi2).alias("chi2"))


def cooccurrences(df: DataFrame, doc: str, token: str, order_by, sep: str | None = None, window_size: int | None = 1, forward: bool = False, min_count: int = 1, chi2: float | None = None, g2: float | None = None) -> DataFrame:
    """token1, token2, count, expected_count, chi2, G2, pmi, npmi of tokens at most `window_size` places apart in a document, or, if that is
    None, of all in its bag of words. chi2, g2: only pairs whose statistic reaches these.

    Pairs within a window are made by lead() at each distance, those of a bag from the counts of its distinct tokens: positions
    are never joined with each other. token1 is the smaller of a pair unless forward, which needs a window.
    """
    names = [order_by] if isinstance(order_by, str) else order_by
    items = df.select(F.col(f"`{doc}`").alias("doc"), *[F.col(f"`{o}`").alias(f"_o{i}") for i, o in enumerate(names)], F.col(f"`{token}`").alias("token"))
    if sep:
        items = items.select("doc", *[c for c in items.columns if c.startswith("_o")], F.posexplode(F.split("token", f"\\Q{sep}\\E")).alias("_p", "token"))
    items = items.filter("token is not null and token <> ''")
    if window_size is None:
        if forward:
            raise ValueError("a bag of words has no direction: give a window")
        bag = items.groupBy("doc", "token").agg(F.count(F.lit(1)).alias("n"))
        other = bag.select(F.col("doc").alias("d2"), F.col("token").alias("token2"), F.col("n").alias("n2"))
        met = bag.join(other, (F.col("doc") == F.col("d2")) & (F.col("token") <= F.col("token2")))
        own = F.col("token") == F.col("token2")
        n = F.when(own, F.expr("n * (n - 1) div 2")).otherwise(F.col("n") * F.col("n2"))
        pairs = met.groupBy(F.col("token").alias("token1"), "token2").agg(F.sum(n).alias("count")).filter("count > 0")
    else:
        w = Window.partitionBy("doc").orderBy(*[c for c in items.columns if c.startswith("_")])
        ahead = F.array(*[F.lead("token", d).over(w) for d in range(1, window_size + 1)])
        met = items.withColumn("_next", ahead).select("token", F.explode("_next").alias("other")).filter("other is not null")
        a, b = (F.col("token"), F.col("other")) if forward else (F.least("token", "other"), F.greatest("token", "other"))
        pairs = met.groupBy(a.alias("token1"), b.alias("token2")).agg(F.count(F.lit(1)).alias("count"))
    j = _with_totals(pairs).filter(F.col("count") >= min_count)
    n, x, y, o = F.col("_pairs"), F.col("t1"), F.col("t2"), F.col("count").cast("double")
    expected, over = x * y / n, F.col("count") >= x * y / n
    pmi = F.log2(o * n / (x * y))
    npmi = F.when(o >= n, 1.0).otherwise(pmi / -F.log2(F.when(o < n, o / n)))
    out = j.select("token1", "token2", "count", expected.alias("expected_count"), F.when(over, _chi2(n, x, y, o)).alias("chi2"), _g2(n, x, y, o).alias("G2"), pmi.alias("pmi"), npmi.alias("npmi"))
    out = out if chi2 is None else out.filter(F.col("chi2") >= chi2)
    return out if g2 is None else out.filter(F.col("G2") >= g2)


def _with_totals(pairs: DataFrame) -> DataFrame:
    """pairs(token1, token2, count) with t1 and t2, the pairs that each token is in (one with itself counts once), and _pairs of all."""
    ends = F.explode(F.when(F.col("token1") == F.col("token2"), F.array("token1")).otherwise(F.array("token1", "token2"))).alias("token")
    totals = pairs.select("count", ends).groupBy("token").agg(F.sum("count").alias("total"))
    whole = pairs.agg(F.sum("count").cast("double").alias("_pairs"))
    one, two = (totals.select(F.col("token").alias(f"token{i}"), F.col("total").cast("double").alias(f"t{i}")) for i in (1, 2))
    return pairs.join(one, "token1").join(two, "token2").crossJoin(F.broadcast(whole))


def _table(n: Column, x: Column, y: Column, o: Column) -> list[tuple[Column, Column]]:
    """(observed, expected) of the four cells of a contingency table."""
    return [(o, x * y / n), (x - o, x * (n - y) / n), (y - o, y * (n - x) / n), (n + o - x - y, (n - x) * (n - y) / n)]


def _chi2(n: Column, x: Column, y: Column, o: Column) -> Column:
    """Where a cell can't be expected: 0 if one of those is empty, else what the first cell alone gives."""
    cells = _table(n, x, y, o)
    terms = [F.pow(v - e, 2) / F.nullif(e, F.lit(0.0)) for v, e in cells]
    empty = [(e == 0) & (v == 0) for v, e in cells]
    return F.when(empty[1] | empty[2] | empty[3], 0.0).otherwise(F.coalesce(terms[0] + terms[1] + terms[2] + terms[3], terms[0]))


def _g2(n: Column, x: Column, y: Column, o: Column) -> Column:
    """Observed cells of 0 or less add nothing; where one can't be expected, what the first cell alone gives."""
    cells = _table(n, x, y, o)
    terms = [F.when(v > 0, v * F.ln(F.when(v > 0, v) / F.nullif(e, F.lit(0.0)))).otherwise(0.0) for v, e in cells]
    return F.coalesce(2 * (terms[0] + terms[1] + terms[2] + terms[3]), terms[0])


def cooccurrence_distribution(df: DataFrame, doc: str, token: str, order_by, sep: str | None = None, window_size: int | None = 1, min_count: int = 1) -> DataFrame:
    """token1, token2, count, expected_count, sd_I, sd_G2: how far the contexts of token1 are those of token2, for each direction of the
    tokens that co-occur. The lesser of the two's positive pmi (G2) with each context that both have, summed, over the sum of
    token1's with all its contexts. Pairs without any such context are left out, as are tokens' pairs with themselves."""
    pairs = cooccurrences(df, doc, token, order_by, sep, window_size).select("token1", "token2", "count", "expected_count", "pmi", "G2")
    back = [F.col("token2").alias("token1"), F.col("token1").alias("token2"), "count", "expected_count", "pmi", "G2"]
    both = durable(pairs.union(pairs.filter("token1 <> token2").select(*back)))
    positive = both.select(F.col("token1").alias("token"), F.col("token2").alias("context"), F.greatest("pmi", F.lit(0.0)).alias("i"), F.greatest("G2", F.lit(0.0)).alias("g"))
    apart = positive.filter("token <> context")
    sums = apart.groupBy("token").agg(F.sum("i").alias("all_i"), F.sum("g").alias("all_g"))
    # of each pair the token of fewer contexts is looked from, by name where they have as many; the other may be a context of itself
    degree = both.groupBy(F.col("token1").alias("token")).agg(F.count(F.lit(1)).alias("d"))
    met = both.filter("token1 <> token2").filter(F.col("count") >= min_count).select("token1", "token2", "count", "expected_count")
    met = met.join(degree.toDF("token1", "d1"), "token1").join(degree.toDF("token2", "d2"), "token2").filter(F.struct("d1", "token1") < F.struct("d2", "token2"))
    one = met.join(apart.toDF("token1", "context", "i1", "g1"), "token1")
    shared = one.join(positive.toDF("token2", "context", "i2", "g2"), ["token2", "context"]).groupBy("token1", "token2").agg(F.first("count").alias("count"), F.first("expected_count").alias("expected_count"), F.sum(F.least("i1", "i2")).alias("i"), F.sum(F.least("g1", "g2")).alias("g"))
    shared = shared.filter("i > 0 or g > 0")
    each = shared.union(shared.select(F.col("token2"), F.col("token1"), "count", "expected_count", "i", "g")).join(sums.toDF("token1", "all_i", "all_g"), "token1")
    return each.select("token1", "token2", "count", "expected_count", (F.col("i") / F.nullif("all_i", F.lit(0.0))).alias("sd_I"), (F.col("g") / F.nullif("all_g", F.lit(0.0))).alias("sd_G2"))


def cluster(df: DataFrame, column: str, key: Column | None = None, name: str = "cluster") -> DataFrame:
    """Values that collide on a key (by default their fingerprint), with their counts: cluster, value, count, where several do."""
    value = F.col(f"`{column}`").cast("string")
    counts = df.groupBy(value.alias("value")).agg(F.count(F.lit(1)).alias("count"))
    k = key if key is not None else scalars.FUNCTIONS["fingerprint"](None, Val(F.col("value"), "str")).col
    keyed = counts.withColumn(name, k)
    several = keyed.groupBy(name).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n")
    return keyed.join(several, name).select(name, "value", "count")


