"""Language ID (operator 7): prediction by partial matching.

Each language has a context tree of bytes of order 3 (PPM with escape method
C, statistics frozen after training, no exclusions).  The code length of a text
under every language is exact: at each byte the longest context that saw the
byte codes it, after the escapes of the longer contexts that did not.  The
shortest code wins.

Training reads a bounded sample; its tables are therefore small whatever the
corpus, and go to the tasks as a broadcast.  Scoring is one pass of Arrow
batches, a gather of precomputed code lengths per byte for all languages.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docskein.llm.common import need, slices

ORDER = 3
CHUNK = 1 << 20
OVERDRAW = 4
# Bits that any text may take more, how many times the usual code length per byte
# is too much, and a length per byte that never is.
SLACK, MARGIN, FLOOR = 64.0, 1.5, 4.0
LETTER = re.compile(r"[^\W\d_]")  # and numerals such as one half, which isalpha() leaves out
UNDETERMINED = "und"


def held_out(doc_id: Column) -> Column:
    """Whether a document is never learned from: crc32 of its id as text, mod 3, is 1."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def has_letter(text: str) -> bool:
    return any(m[0].isalpha() for m in LETTER.finditer(text))


def grams(data: bytes, start: bytes = b"\n" * ORDER) -> np.ndarray:
    """For every byte, that byte and the ORDER bytes before it as one integer."""
    x = np.frombuffer(start + data, dtype=np.uint8).astype(np.uint32)
    return (x[:-3] << 24) | (x[1:-2] << 16) | (x[2:-1] << 8) | x[3:]


class ContextTrees:
    """Frozen PPM statistics of several languages, resolved to code lengths."""

    def __init__(self, texts: dict[str, list[str]]) -> None:
        self.langs = sorted(texts)
        every = [np.concatenate([grams(t.encode("utf-8")) for t in texts[lang]] or [np.zeros(0, np.uint32)]) for lang in self.langs]
        self.keys: list[np.ndarray] = []
        self.cost: list[np.ndarray] = []
        self.contexts: list[np.ndarray] = []
        self.escape: list[np.ndarray] = []
        for k in range(ORDER + 1):
            mask = np.uint32((1 << 8 * (k + 1)) - 1)
            counted = [np.unique(g & mask, return_counts=True) for g in every]
            keys = np.unique(np.concatenate([u for u, _ in counted]))
            contexts = np.unique(keys >> np.uint32(8))
            of = np.searchsorted(contexts, keys >> np.uint32(8))
            # Not seen in a language: its escape, then the shorter context.
            if k:
                below = self.cost[k - 1][np.searchsorted(self.keys[k - 1], keys & np.uint32((1 << 8 * k) - 1))]
            else:
                below = np.full((len(keys), len(self.langs)), 8.0)
            cost, escape = below.copy(), np.zeros((len(contexts), len(self.langs)))
            for j, (u, n) in enumerate(counted):
                at = np.searchsorted(keys, u)
                total = np.bincount(of[at], weights=n, minlength=len(contexts))
                kinds = np.bincount(of[at], minlength=len(contexts))
                seen = kinds > 0
                escape[seen, j] = np.log2((total[seen] + kinds[seen]) / kinds[seen])
                cost[:, j] += escape[of, j]
                cost[at, j] = np.log2((total[of[at]] + kinds[of[at]]) / n)
            self.keys.append(keys)
            self.cost.append(cost)
            self.contexts.append(contexts)
            self.escape.append(escape)
        self._table()
        self.limits = np.full(len(self.langs), np.inf)

    def calibrate(self, texts: dict[str, list[str]]) -> None:
        """The most bits per byte that a text of each language may take: MARGIN
        times the length that 99 of 100 of ``texts`` (none of them learned) stay
        within, and at least FLOOR.  Languages without such a text get no limit."""
        for j, lang in enumerate(self.langs):
            raw = [t.encode("utf-8") for t in texts.get(lang, ())]
            if raw:
                self.limits[j] = max(FLOOR, MARGIN * np.quantile([self.code_lengths(t)[j] / len(t) for t in raw], 0.99))

    def _table(self) -> None:
        """A direct table over hashed 4-byte keys; what collides is searched."""
        self.bits = 20
        self.table = np.zeros(1 << self.bits, dtype=np.int32)
        self.table[self._slot(self.keys[ORDER])] = np.arange(len(self.keys[ORDER]), dtype=np.int32)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint32(2654435761)) >> np.uint32(32 - self.bits)

    def code_lengths(self, data: bytes) -> np.ndarray:
        """Bits that ``data`` takes in each language."""
        bits = np.zeros(len(self.langs))
        for at in range(0, len(data), CHUNK):
            before = (b"\n" * ORDER + data[max(0, at - ORDER) : at])[-ORDER:]
            bits += self._chunk(grams(data[at : at + CHUNK], before))
        return bits

    def _chunk(self, g: np.ndarray) -> np.ndarray:
        keys = self.keys[ORDER]
        at = self.table[self._slot(g)]
        hit = keys[at] == g
        bits = np.ones(int(hit.sum())) @ self.cost[ORDER][at[hit]]
        g = g[~hit]
        for k in range(ORDER, -1, -1):
            if not len(g):
                return bits
            own = g & np.uint32((1 << 8 * (k + 1)) - 1)
            at, hit = _find(self.keys[k], own)
            bits = bits + np.ones(int(hit.sum())) @ self.cost[k][at[hit]]
            g, own = g[~hit], own[~hit]
            at, hit = _find(self.contexts[k], own >> np.uint32(8))
            bits = bits + np.ones(int(hit.sum())) @ self.escape[k][at[hit]]
        return bits + 8.0 * len(g)

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language, posterior under equal priors, whether the code length is
        one of that language); und, 0 and false without a letter."""
        if not text or not self.langs or not has_letter(text):
            return UNDETERMINED, 0.0, False
        raw = text.encode("utf-8")
        bits = self.code_lengths(raw)
        best = int(bits.argmin())
        return self.langs[best], float(1.0 / np.exp2(np.maximum(bits[best] - bits, -1000.0)).sum()), bool(bits[best] - SLACK <= self.limits[best] * len(raw))


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def training_sample(docs: DataFrame, *, id_col: str, text_col: str, lang_col: str, docs_per_lang: int, max_chars: int, max_langs: int) -> DataFrame:
    """(lang, text, rank): at most ``docs_per_lang`` labelled documents of each of
    the ``max_langs`` commonest labels, the first by a hash, and of each its first
    ``max_chars`` code points.

    Labels are counted first, so that only documents whose hash lies below a
    bound that leaves about OVERDRAW times as many as wanted are ranked: what is
    shuffled depends on the sample's size, not on the corpus.  Rows of the id with
    the least hash are always among them, so a label whose rows repeat few ids
    is not lost."""
    doc = F.col(id_col)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc", "text"))
    labelled = docs.where(doc.isNotNull() & ~held_out(doc) & F.col(lang_col).isNotNull() & (F.length(text_col) > 0))
    labels = labelled.groupBy(F.col(lang_col).alias("lang")).agg(F.count(F.lit(1)).alias("n"), F.min(F.xxhash64(doc)).alias("first")).orderBy(F.desc("n"), "lang").limit(max_langs)
    share = OVERDRAW * docs_per_lang / F.col("n")
    drawn = labelled.select(F.col(lang_col).alias("lang"), F.xxhash64(doc).alias("h"), doc.alias("doc"), F.col(text_col).alias("text")).join(F.broadcast(labels), "lang")
    drawn = drawn.where((share >= 1) | (F.col("h") == F.col("first")) | (F.col("h").cast("double") / 2.0**64 + 0.5 < share)).withColumn("text", F.substring("text", 1, max_chars))
    return drawn.withColumn("rank", rank).where(F.col("rank") <= docs_per_lang).select("lang", "text", "rank")


def identify_language(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", docs_per_lang: int = 200, fit_docs: int = 50, max_chars: int = 20_000, max_langs: int = 200
) -> DataFrame:
    """``docs`` plus lang_pred, score and fits (columns so called are replaced).

    Learns from labelled documents that ``held_out`` leaves, at most
    ``docs_per_lang`` of each of the ``max_langs`` commonest labels and of each
    at most its first ``max_chars`` code points (the bound of the sample and of
    the broadcast); predicts from text alone, and reads the whole text.  fits
    tells whether the text's code length is one that texts of the predicted
    language have: at most MARGIN times what 99 of 100 of ``fit_docs`` further
    labelled documents stay within, and FLOOR at least (true where there are none).

    Null or letterless text: und with score 0, and no fit.  Without any labelled
    document everything is und.  Ties go to the first language in code-point
    order.  Repeated rows get equal predictions.
    """
    need(docs, id=id_col, text=text_col, lang=lang_col)
    spark = docs.sparkSession
    sample: dict[str, list[str]] = {}
    others: dict[str, list[str]] = {}
    drawn = training_sample(docs, id_col=id_col, text_col=text_col, lang_col=lang_col, docs_per_lang=docs_per_lang + fit_docs, max_chars=max_chars, max_langs=max_langs)
    for row in drawn.toLocalIterator():
        (sample if row["rank"] <= docs_per_lang else others).setdefault(row.lang, []).append(row.text)
    model = ContextTrees({k: sorted(v) for k, v in sample.items()}) if sample else None
    if model:
        model.calibrate(others)
    trees = spark.sparkContext.broadcast(model)
    own = [c for c in docs.columns if c.lower() not in ("lang_pred", "score", "fits")]
    text_at, keep = docs.columns.index(text_col), [docs.columns.index(c) for c in own]
    schema = docs.select(*[F.col(f"`{c}`") for c in own]).schema.add("lang_pred", "string").add("score", "double").add("fits", "boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = trees.value
        for part in slices(batches):
            texts = part.column(text_at).to_pylist()
            made = [model.predict(t) if model else (UNDETERMINED, 0.0, False) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [*(part.column(i) for i in keep), *(pa.array([m[k] for m in made], t) for k, t in enumerate((pa.string(), pa.float64(), pa.bool_())))],
                names=[*own, "lang_pred", "score", "fits"],
            )

    return docs.mapInArrow(run, schema)


# --- query ------------------------------------------------------------------

NAME = "op7_language_id"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    return identify_language(docs).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
