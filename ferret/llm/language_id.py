"""Language identification of web pages by Bayesian evidence fusion.

Four kinds of evidence are combined in log space: (1) the likelihood of the page's main text under hashed byte-trigram
models of the languages, trained on all documents that declare one; (2) the markup's declared language and (3) the
address suffix (a two-letter first path part, else the top-level domain), each with the reliability that grouped
aggregation over all pages finds for it; (4) a prior of the host, smoothed towards its domain, which is smoothed
towards all pages. The counts behind (2) to (4) are grouped sums of the pages' posteriors given their text; a page's
own count is taken out of its evidence.

Byte trigrams are not independent, so the text's log likelihood is multiplied by ``TEMPER``.

Edge cases: null or empty html has no text evidence and is decided by the rest; a null url has the empty host;
missing declarations and suffixes are values of their own; documents without lang or text teach nothing; with no such
documents lang is null; ties go to the language first in code-point order; repeated rows each give a row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferret.llm.common import Text, list_array, slices, stage
from ferret.llm.html_text import main_text

BUCKETS, TEMPER, STRENGTH = 1 << 14, 0.1, 2.0


def trigrams(t: Text) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every byte trigram inside a document, and its document."""
    d = t.data.astype(np.uint32)
    if len(d) < 3:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    g = ((d[:-2] << 16 | d[1:-1] << 8 | d[2:]) * np.uint32(2654435761)) >> np.uint32(32 - 14)
    doc = np.repeat(np.arange(t.n), np.diff(t.off))
    inside = doc[:-2] == doc[2:]
    return g[inside].astype(np.int64), doc[:-2][inside]


def language_models(docs: DataFrame, max_languages: int = 500) -> tuple[list[str], np.ndarray]:
    """Languages in code-point order and their log P(trigram), from all documents."""
    known = docs.where("lang is not null and text is not null")
    langs = sorted(r.lang for r in known.select("lang").distinct().limit(max_languages + 1).collect())
    if len(langs) > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    number = {x: i for i, x in enumerate(langs)}

    def count(batches):
        total = np.zeros(len(langs) * BUCKETS, np.int64)
        for b in batches:
            for s in slices(b, "text"):
                g, doc = trigrams(Text(s.column("text"), lower=True))
                code = np.array([number[x] for x in s.column("lang").to_pylist()])
                total += np.bincount(code[doc] * BUCKETS + g, minlength=len(total))
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["cell", "n"])

    table = np.zeros(len(langs) * BUCKETS)
    if langs:
        summed = known.select("lang", "text").mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
        table[summed.column("cell").to_numpy()] = summed.column("n").to_numpy()  # at most languages x BUCKETS rows
    table = table.reshape(len(langs), BUCKETS) + 0.5
    return langs, np.log(table / table.sum(axis=1, keepdims=True))


def page_evidence(pages: DataFrame, langs: list[str], logp: np.ndarray) -> DataFrame:
    """Host, domain, declared language, suffix and tempered text log likelihoods of every page."""
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    path = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"://[^/?#]*/([A-Za-z]{2})(?:[/?#]|$)", 1))
    tld = F.regexp_extract(host, r"\.([a-z]+)$", 1)
    declared = F.lower(F.regexp_extract(F.coalesce("html", F.lit("")), r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]{2,3})", 1))

    def score(batches):
        for b in batches:
            for s in slices(b, "html"):
                text = pa.array([main_text(x) for x in s.column("html").to_pylist()], pa.string())
                t = Text(text, lower=True)
                g, doc = trigrams(t)
                ll = np.stack([np.bincount(doc, logp[i][g], t.n) for i in range(len(langs))], axis=1) * TEMPER
                yield pa.RecordBatch.from_arrays(
                    [*[s.column(c) for c in ("page_id", "url", "host", "domain", "declared", "suffix")], list_array(ll.ravel(), np.arange(t.n + 1) * len(langs))],
                    names=["page_id", "url", "host", "domain", "declared", "suffix", "ll"])

    src = pages.select(
        F.col("page_id").cast("long").alias("page_id"), "url", host.alias("host"),
        F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1).alias("domain"), declared.alias("declared"),
        F.when(path != "", F.concat(F.lit("/"), path)).otherwise(F.concat(F.lit("."), tld)).alias("suffix"), "html")
    return src.mapInArrow(score, "page_id long, url string, host string, domain string, declared string, suffix string, ll array<double>")


def softmax(ll: Column) -> Column:
    raised = F.transform(ll, lambda x: F.exp(x - F.array_max(ll)))
    return F.transform(raised, lambda x: x / F.aggregate(raised, F.lit(0.0), lambda a, b: a + b))


def identify(docs: DataFrame, pages: DataFrame) -> DataFrame:
    """page_id, url, lang, probability, text_lang, declared, host of every page."""
    langs, logp = language_models(docs)
    n = len(langs)
    if not n:
        return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.lit(None).cast("string").alias("lang"), F.lit(None).cast("double").alias("probability"),
                            F.lit(None).cast("string").alias("text_lang"), F.lit(None).cast("string").alias("declared"), F.lit("").alias("host"))
    page = stage(page_evidence(pages, langs, logp).withColumn("p", softmax(F.col("ll"))), "pages")
    # posteriors in millionths: integer sums do not depend on the order of addition
    page = page.withColumn("q", F.transform("p", lambda x: F.round(x * 1_000_000).cast("long")))
    sums = lambda *by: [F.array(*[F.sum(F.col("q")[i]) for i in range(n)]).alias(f"sum_{by[-1]}")]
    every = page.select(*sums("all")).scalar()
    by_host = page.groupBy("host", "domain").agg(*sums("host"))
    by_domain = by_host.groupBy("domain").agg(F.array(*[F.sum(F.col("sum_host")[i]) for i in range(n)]).alias("sum_domain"))
    by_declared = page.groupBy("declared").agg(*sums("declared"))
    by_suffix = page.groupBy("suffix").agg(*sums("suffix"))
    x = page.join(by_host, ["host", "domain"]).join(by_domain, "domain").join(by_declared, "declared").join(by_suffix, "suffix").withColumn("sum_all", every)
    less = lambda c, i: F.greatest(F.lit(0.0), (F.col(c)[i] - F.col("q")[i]) / 1e6)  # noqa: E731  without the page itself
    total = lambda c: F.greatest(F.lit(0.0), (F.aggregate(F.col(c), F.lit(0).cast("long"), lambda a, b: a + b)) / 1e6 - 1)
    fused = []
    for i in range(n):
        base = (less("sum_all", i) + 1.0 / n) / (total("sum_all") + 1)
        domain = (less("sum_domain", i) + STRENGTH * base) / (total("sum_domain") + STRENGTH)
        prior = (less("sum_host", i) + STRENGTH * domain) / (total("sum_host") + STRENGTH)
        # P(value | language), smoothed by how common the value is
        seen = less("sum_all", i)
        declared = (less("sum_declared", i) + STRENGTH * (total("sum_declared") + 1) / (total("sum_all") + 1)) / (seen + STRENGTH)
        suffix = (less("sum_suffix", i) + STRENGTH * (total("sum_suffix") + 1) / (total("sum_all") + 1)) / (seen + STRENGTH)
        fused.append(F.col("ll")[i] + F.log(prior) + F.log(declared) + F.log(suffix))
    names = F.array(*[F.lit(v) for v in langs])
    x = x.withColumn("post", softmax(F.array(*fused)))
    pick = lambda c: F.element_at(names, F.array_position(c, F.array_max(c)).cast("int"))
    return x.select("page_id", "url", pick(F.col("post")).alias("lang"), F.array_max("post").alias("probability"),
                    pick(F.col("p")).alias("text_lang"), F.when(F.col("declared") != "", F.col("declared")).alias("declared"), "host")


def op8_language_id(spark, sf_dir: str) -> DataFrame:
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/pages.parquet"))
