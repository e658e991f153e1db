"""Language identification by Bayesian fusion of evidence.

The posterior of a language multiplies
- the text's likelihood: hashed byte trigrams of its letters under a naive Bayes model, tempered since
  neighbouring trigrams overlap. The model has every label that occurs, lower-cased and trimmed as what is
  declared, and is fitted on at most ``per_language`` rows of each, taken by a hash of their id;
- the declared (markup) language's and the address suffix's likelihoods: how often rows whose text
  alone is clear declare it, by language, smoothed towards its overall share;
- the prior of the host: the languages of its clear rows, smoothed towards those of the domain above it, these
  towards the next one's, and so on up to the corpus's. A host without clear rows has its domain's prior.
The last three are grouped aggregations over all rows, joined back by their keys; hosts are never
collected or broadcast unless adaptive execution finds their table small.

Where the declaration is also the label that the text model is fitted by, as for documents, a row of the sample
doesn't declare anything: no row's own label is evidence about it.

Beside the languages stands the class of no known language: each trigram is as likely as any other under it, it
declares what all rows declare, and its prior is ``UNKNOWN``. Random letters and scripts outside the model are
likelier under it; a language that shares many trigrams with one of the model's is taken for that.

Missing evidence (null, or a column not given) is neutral. A text without three letters in a run of
characters has no likelihood of its own. A row is accepted if some language's posterior reaches
``confidence`` and the text itself has letters; null and empty texts are rejected.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm import html_text
from strata.llm.common import raw_texts, remembered, staged

FEATURES = 1 << 15
PER_LANGUAGE = 5_000
#: Languages up to which the weights are one dense table, and of which a worker counts at once; more are kept sparse.
DENSE = 64
TEMPER, SMOOTH, STRENGTH = 1 / 3, 0.5, 20.0
CLEAR, CONFIDENCE, UNKNOWN = 0.95, 0.5, 0.01
#: A row is in the sample if its key's hash, of so many values, is under its label's share of them.
SCALE = 1 << 30
#: Labels of the domains above a host that have counts of their own.
DOMAINS = (2, 3, 4)
#: Bytes looked at in one step.
STEP = 1 << 18

#: Letters lower-cased, bytes of non-ASCII characters kept, all else a space.
LETTERS = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))


def trigrams(raw: bytes):
    """Arrays of the hashed trigrams of a text, those of white space alone left out."""
    letters = np.frombuffer(raw.translate(LETTERS), np.uint8)
    for low in range(0, len(letters) - 2, STEP):
        x = letters[low : low + STEP + 2].astype(np.uint32)
        a, b, c = x[:-2], x[1:-1], x[2:]
        yield ((a * 961 + b * 31 + c) * np.uint32(2654435761) >> np.uint32(17))[(a != 32) | (b != 32) | (c != 32)]


def normal(c: Column) -> Column:
    """A language tag, address suffix or host as it is compared."""
    return F.nullif(F.lower(F.trim(c)), F.lit(""))


@dataclass
class TextModel:
    languages: list[str]
    #: log P(trigram | language). Dense: a row for each trigram. Sparse: what a trigram adds to ``base``, the
    #: weight of trigrams that a language hasn't, for the languages ``who`` between two of ``starts``.
    weights: np.ndarray
    base: np.ndarray | None = None
    who: np.ndarray | None = None
    starts: np.ndarray | None = None
    shares: dict[str, int] | None = None

    def fitted_on(self, label: Column, key: Column) -> Column:
        """Whether a row is in the sample that the model was fitted on."""
        pairs = [F.lit(x) for kv in (self.shares or {}).items() for x in kv]
        share = F.try_element_at(F.create_map(*pairs), normal(label.cast("string"))) if pairs else F.lit(None)
        return F.coalesce(F.pmod(F.xxhash64(key), F.lit(SCALE)) < share, F.lit(False))

    def score(self, raw: bytes) -> tuple[int, np.ndarray]:
        """Number of trigrams, and log-likelihoods by language."""
        n, total = 0, np.zeros(len(self.languages))
        for x in trigrams(raw):
            n += len(x)
            if self.base is None:
                total += self.weights[x].sum(axis=0, dtype=np.float64)
                continue
            ids, times = np.unique(x, return_counts=True)
            low, sizes = self.starts[ids], self.starts[ids + 1] - self.starts[ids]
            at = np.arange(sizes.sum()) + np.repeat(low - np.cumsum(sizes) + sizes, sizes)
            total += np.bincount(self.who[at], self.weights[at] * np.repeat(times, sizes), len(total))
        return n, total if self.base is None else total + n * self.base


def fit(rows: DataFrame, label: str, key: str = "doc_id", text: str = "text", per_language: int = PER_LANGUAGE) -> TextModel:
    """From labelled rows. The driver gets the labels, and the weights of the trigrams that each language's sample has."""
    labelled = rows.select(normal(F.col(label).cast("string")).alias("label"), F.xxhash64(key).alias("at"), F.col(text).alias("text")).where("label is not null")
    counts = labelled.groupBy("label").count().collect()
    share = sorted((r[0], min(SCALE, per_language * SCALE // r[1])) for r in counts)
    languages = [k for k, _ in share]
    if not languages:
        return TextModel([], np.zeros((FEATURES, 0), np.float32))
    shares = rows.sparkSession.createDataFrame([(k, i, v) for i, (k, v) in enumerate(share)], "label string, language int, share long")
    sample = labelled.join(F.broadcast(shares), "label").where(F.pmod("at", F.lit(SCALE)) < F.col("share")).select("language", "text")

    def batch_of(languages, sparse, kind):
        return pa.RecordBatch.from_arrays(
            [pa.array(languages, pa.int32()), pa.array([i.astype("<u2").tobytes() for i, _ in sparse], pa.binary()), pa.array([x.astype(kind).tobytes() for _, x in sparse], pa.binary())],
            names=["language", "ids", "numbers"],
        )

    def run(batches):
        remembered("language_id")
        own: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, raw in zip(batch.column(0).to_pylist(), raw_texts(batch.column(1)), strict=True):
                if k not in own:
                    if len(own) >= DENSE:
                        yield batch_of(list(own), [(i := np.flatnonzero(x), x[i]) for x in own.values()], "<i8")
                        own.clear()
                    own[k] = np.zeros(FEATURES, np.int64)
                for x in trigrams(raw):
                    own[k] += np.bincount(x, minlength=FEATURES)
        yield batch_of(list(own), [(i := np.flatnonzero(x), x[i]) for x in own.values()], "<i8")

    def weigh(total):
        ids = np.flatnonzero(total)
        n = total.sum() + SMOOTH * FEATURES
        return np.append(ids, FEATURES), np.log((np.append(total[ids], 0) + SMOOTH) / n)  # the last is of all other trigrams

    def add(batches):
        last, total = None, np.zeros(FEATURES)
        for batch in batches:
            for k, ids, numbers in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if k != last and last is not None:
                    yield batch_of([last], [weigh(total)], "<f4")
                    total[:] = 0
                last = k
                total[np.frombuffer(ids, "<u2")] += np.frombuffer(numbers, "<i8")
        if last is not None:
            yield batch_of([last], [weigh(total)], "<f4")

    schema = "language int, ids binary, numbers binary"
    found = {r.language: (np.frombuffer(r.ids, "<u2"), np.frombuffer(r.numbers, "<f4")) for r in sample.mapInArrow(run, schema).repartition("language").sortWithinPartitions("language").mapInArrow(add, schema).toLocalIterator()}
    none = np.full(len(languages), -np.log(FEATURES))
    for k, (ids, x) in found.items():
        none[k], found[k] = x[-1], (ids[:-1], x[:-1])
    if len(languages) <= DENSE:
        weights = np.tile(none.astype(np.float32), (FEATURES, 1))
        for k, (ids, x) in found.items():
            weights[ids, k] = x
        return TextModel(languages, weights, shares=dict(share))
    sizes = np.zeros(FEATURES + 1, np.int64)
    for ids, _ in found.values():
        sizes[ids.astype(np.int64) + 1] += 1
    starts = np.cumsum(sizes)
    who, weights, free = np.zeros(starts[-1], np.int32), np.zeros(starts[-1], np.float32), starts[:-1].copy()
    for k, (ids, x) in found.items():
        who[free[ids]], weights[free[ids]] = k, x - none[k]
        free[ids] += 1
    return TextModel(languages, weights, none, who, starts, dict(share))


def _likelihoods(rows: DataFrame, model: TextModel, names: list[str]) -> DataFrame:
    """``rows`` (names..., text last) with n and the tempered log-likelihoods instead of the text."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        remembered("language_id")
        for batch in batches:
            found = [shared.value.score(raw) for raw in raw_texts(batch.column(len(names)))]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array([n for n, _ in found], pa.int64()), pa.array([(TEMPER * x).tolist() for _, x in found], pa.list_(pa.float64()))],
                names=[*names, "n", "ll"],
            )

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[:-1])
    return rows.mapInArrow(run, f"{schema}, n long, ll array<double>")


def _posterior(logs: Column) -> Column:
    top = F.array_max(logs)
    odds = F.transform(logs, lambda x: F.exp(x - top))
    total = F.aggregate(odds, F.lit(0.0), lambda a, x: a + x)
    return F.transform(odds, lambda x: x / total)


def _add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def _counted(clear: DataFrame, key: str) -> DataFrame:
    """Clear rows by key and language of their text."""
    return clear.where(F.col(key).isNotNull()).groupBy(key, "_text").agg(F.count("*").cast("double").alias("c"))


def _by_key(counted: DataFrame, *keys: str) -> DataFrame:
    """A row for each key: m, its counts by language, and t, their sum."""
    return counted.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("_text", "c"))).alias("m"), F.sum("c").alias("t"))


def _of(counts: str, i: Column) -> Column:
    return F.coalesce(F.try_element_at(counts, i), F.lit(0.0))


def host_priors(spark: SparkSession, scored: DataFrame, clear: DataFrame, overall: list[float]) -> DataFrame:
    """A row for each host: _host, and _p, its languages' shares smoothed from domain to domain."""
    parts = F.split("_host", r"\.")
    counted = staged(spark, _counted(clear, "_host"), "host-counts")
    hosts = scored.where("_host is not null").select("_host").distinct().withColumn("_p", F.array(*[F.lit(p) for p in overall]))
    smoothed = F.transform("_p", lambda p, i: (_of("m", i) + STRENGTH * p) / (F.coalesce("t", F.lit(0.0)) + STRENGTH))
    for width in (*DOMAINS, None):
        key = F.col("_host") if width is None else F.when(F.size(parts) > width, F.concat_ws(".", F.slice(parts, F.size(parts) - width + 1, width)))
        sums = counted.select(key.alias("_k"), "_text", "c").where("_k is not null").groupBy("_k", "_text").agg(F.sum("c").alias("c"))
        hosts = hosts.join(_by_key(sums, "_k"), key == F.col("_k"), "left").select("_host", smoothed.alias("_p"))
    return hosts


def identify(
    spark: SparkSession, rows: DataFrame, model: TextModel, keys: list[str], text: str = "text",
    declared: Column | None = None, suffix: Column | None = None, host: Column | None = None, confidence: float = CONFIDENCE,
) -> DataFrame:
    """A row for each of ``rows``: its keys, lang, confidence, accepted and text_lang (by the text alone)."""
    size = len(model.languages)
    own = [c if c is not None else F.lit(None).cast("string") for c in (declared, suffix, host)]
    ready = rows.select(*keys, *(normal(c).alias(n) for c, n in zip(own, ("_declared", "_suffix", "_host"), strict=True)), text)
    names = [*keys, "_declared", "_suffix", "_host"]
    if not size:
        return rows.select(*keys, F.lit(None).cast("string").alias("lang"), F.lit(0.0).alias("confidence"), F.lit(False).alias("accepted"), F.lit(None).cast("string").alias("text_lang"))
    scored = _likelihoods(ready, model, names)
    scored = scored.withColumn("_p", _posterior(F.col("ll"))).withColumn("_best", F.array_max("_p"))
    scored = scored.withColumn("_text", F.when(F.col("n") > 0, (F.array_position("_p", F.col("_best")) - 1).cast("int")))
    scored = staged(spark, scored.drop("_p"), "likelihoods")
    clear = scored.where((F.col("_best") >= CLEAR) & F.col("_text").isNotNull())
    whole = {r[0]: r[1] for r in clear.groupBy("_text").count().collect()}
    overall = [(whole.get(i, 0) + 1) / (sum(whole.values()) + size) for i in range(size)]
    neutral = F.array_repeat(F.lit(0.0), size)
    logs = F.when(F.col("n") > 0, F.col("ll")).otherwise(neutral)
    unknown = F.lit(float(np.log(UNKNOWN))) - F.col("n") * float(TEMPER * np.log(FEATURES))
    fused, used_host = scored, host is not None
    for name, given in (("_declared", declared), ("_suffix", suffix)):
        if given is None:
            continue
        counted = _counted(clear, name)
        seen = {r[0]: r[1] for r in counted.groupBy("_text").agg(F.sum("c")).collect()}
        n_all = max(1.0, sum(seen.values()))
        table, given_n = _by_key(counted, name), F.array(*[F.lit(seen.get(i, 0.0)) for i in range(size)])
        likelihood = F.transform(given_n, lambda s, i: F.log((_of("m", i) + STRENGTH * F.col("t") / n_all) / (s + STRENGTH)))  # noqa: B023
        fused = fused.join(table.select(F.col(name).alias(f"{name}_k"), likelihood.alias(f"{name}_l"), F.log(F.col("t") / n_all).alias(f"{name}_u")), F.col(name) == F.col(f"{name}_k"), "left").drop(f"{name}_k")
        logs = _add(logs, F.coalesce(f"{name}_l", neutral))
        unknown += F.coalesce(f"{name}_u", F.lit(0.0))
    prior = F.array(*[F.lit(float(np.log(p))) for p in overall])
    if used_host:
        hosts = host_priors(spark, scored, clear, overall).select(F.col("_host").alias("_host_k"), F.transform("_p", lambda p: F.log(p)).alias("_host_l"))
        fused = fused.join(hosts, F.col("_host") == F.col("_host_k"), "left")
        prior = F.coalesce("_host_l", prior)
    fused = fused.withColumn("_post", _posterior(F.concat(_add(logs, prior), F.array(unknown)))).withColumn("confidence", F.array_max(F.slice("_post", 1, size)))
    tags = F.array(*[F.lit(x) for x in model.languages])
    best = F.element_at(tags, F.array_position("_post", F.col("confidence")).cast("int"))
    accepted = (F.col("confidence") >= confidence) & (F.col("n") > 0)
    return fused.select(
        *keys, F.when(accepted, best).alias("lang"), F.col("confidence"), accepted.alias("accepted"),
        F.when(F.col("_text").isNotNull(), F.element_at(tags, F.col("_text") + 1)).alias("text_lang"),
    )


def fit_documents(docs: DataFrame, per_language: int = PER_LANGUAGE) -> TextModel:
    """The text model, from documents labelled by ``lang``."""
    return fit(docs.select("doc_id", "text", "lang"), "lang", per_language=per_language)


def identify_documents(spark: SparkSession, docs: DataFrame, per_language: int = PER_LANGUAGE, model: TextModel | None = None) -> DataFrame:
    """Documents: ``lang`` labels the model's sample and is what the others declare; ``source`` is the host."""
    keyed = docs.select("doc_id", "text", "lang", "source", F.xxhash64("text").alias("h"))
    model = model or fit_documents(keyed, per_language)
    source = F.lower("source")
    declared = F.when(~model.fitted_on(F.col("lang"), F.col("doc_id")), F.col("lang"))
    return identify(spark, keyed, model, ["doc_id", "h"], declared=declared, suffix=_suffix(source), host=source)


def _suffix(host: Column) -> Column:
    return F.nullif(F.regexp_extract(host, r"\.([a-z]{2,})$", 1), F.lit(""))


def identify_pages(spark: SparkSession, pages: DataFrame, model: TextModel) -> DataFrame:
    """Pages ``(page_id, url, html)`` by their main texts, the ``lang`` of their html elements, and their addresses."""
    declared = F.regexp_extract("html", r"""(?is)<html\b[^>]*?\slang\s*=\s*["']?([a-z]+)""", 1)
    host = F.lower(F.regexp_extract("url", r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    rows = html_text.extract(pages.select("page_id", declared.alias("declared"), host.alias("host"), "html"))
    return identify(spark, rows, model, ["page_id"], declared=F.col("declared"), suffix=_suffix(F.col("host")), host=F.col("host"))


def keep_identified(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """``docs`` without the rows whose language can't be told; all columns kept, ``lang`` as declared."""
    rejected = identify_documents(spark, docs).where(~F.col("accepted"))
    rejected = staged(spark, rejected.select(F.col("doc_id").alias("_strata_d"), F.col("h").alias("_strata_h")).distinct(), "rejected")
    on = F.col("doc_id").eqNullSafe(F.col("_strata_d")) & (F.xxhash64("text") == F.col("_strata_h"))
    return docs.join(rejected, on, "left_anti")
