"""Language identification with bit-sliced Bloom filters over n-grams.

One table of bit masks serves as a Bloom filter per language: slot s holds a
bit for each language whose filter has s set, so the masks at an n-gram's slots,
and-ed, give all languages that contain it. Each language's hits are counted
over a text and corrected for the share of n-grams that its filter lets through
by chance.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from covalens.llm import common

N = 5


def _letters() -> np.ndarray:
    """ASCII letters lower-cased, bytes beyond ASCII as they are, anything else a blank."""
    table = np.full(256, 32, np.uint8)
    table[97:123] = table[65:91] = np.arange(97, 123)
    table[128:] = np.arange(128, 256)
    return table


_FOLD = _letters()


def grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the N-byte n-grams around letters, text after text, and n + 1 offsets. Null is empty.

    Texts are lower-cased, and all but letters becomes blank; a blank stands at either end.
    """
    lowered = pa.array([f" {(x or '').lower()} " + " " * (N - 1) for x in texts.to_pylist()], pa.large_string())
    data, offsets = common.flat(lowered)
    if not len(data):
        return np.zeros(0, np.uint64), offsets
    folded = _FOLD[data]
    padded = np.zeros(len(folded) + 8, np.uint8)
    padded[:-8] = folded
    words = np.ndarray((len(folded),), "<u8", padded, strides=(1,)) & common.u64((1 << 8 * N) - 1)
    own = padded[1 : len(folded) + 1] != 32  # of the N - 1 blanks at the end none starts one
    ends = offsets[1:, None] - np.arange(1, N)[None, :]
    own[np.maximum(ends.ravel(), 0)] = False
    at = np.flatnonzero(own)
    return common.mixed(words[at] + common.u64(0x2545F4914F6CDD1D)), np.searchsorted(at, offsets)


class Filters:
    """Bloom filters of all languages, bit-sliced; plain data, so that it travels to the workers."""

    def __init__(self, langs: list[str], slots: int = 1 << 20, probes: int = 2):
        self.langs, self.slots, self.probes = langs, slots, probes
        self.masks = np.zeros((slots, max(1, -(-len(langs) // 64))), np.uint64)

    def _at(self, hashes: np.ndarray, j: int) -> np.ndarray:
        return ((hashes >> common.u64(20 * j)) % common.u64(self.slots)).astype(np.int64)

    def add(self, lang: int, hashes: np.ndarray) -> None:
        for j in range(self.probes):
            self.masks[self._at(hashes, j), lang // 64] |= common.u64(1 << lang % 64)

    def chance(self) -> np.ndarray:
        """For each language the probability that its filter lets a foreign n-gram through."""
        fill = np.array([((self.masks[:, i // 64] >> common.u64(i % 64)) & common.u64(1)).mean() for i in range(len(self.langs))])
        return fill**self.probes

    def containing(self, hashes: np.ndarray) -> np.ndarray:
        """For each n-gram the bit masks of the languages that contain it."""
        found = self.masks[self._at(hashes, 0)]
        for j in range(1, self.probes):
            found = found & self.masks[self._at(hashes, j)]
        return found

    def counts(self, hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Hits by text and language, corrected for false positives: hits = true + (n - true) x chance."""
        found = self.containing(hashes)
        n = np.diff(offsets)
        out = np.zeros((len(n), len(self.langs)))
        full = np.flatnonzero(n)
        for i, chance in enumerate(self.chance()):
            bits = ((found[:, i // 64] >> common.u64(i % 64)) & common.u64(1)).astype(np.uint8)
            if len(full):
                out[full, i] = np.add.reduceat(bits, offsets[full], dtype=np.int64)
            out[:, i] = np.maximum(0, (out[:, i] - n * chance) / (1 - min(chance, 0.999)))
        return out


def train(docs: DataFrame, modulus: int = 4, excluded: int = 2, bound: int = 1500, share: float = 0.005) -> Filters:
    """Filters from documents with a lang whose crc32(doc_id as text) mod 4 is not 2.

    About ``bound`` documents a language at most, those with the least hashes of
    doc_id, are read whole; an n-gram belongs to a language if ``share`` of its
    documents, and two at least where there are two, have it.
    """
    mine = F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus != excluded
    docs = docs.where(mine & F.col("lang").isNotNull()).select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"), (F.xxhash64("doc_id", F.lit(11)) / F.lit(float(1 << 63))).alias("draw"))
    sizes = {r.lang: r.n for r in docs.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(sizes)
    filters = Filters(langs)
    if not langs:
        return filters
    rate = F.create_map(*[F.lit(x) for lang in langs for x in (lang, min(1.0, bound / sizes[lang]))])
    sample = docs.where((F.col("draw") + 1) / 2 <= rate[F.col("lang")])

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                h, offsets = grams(batch.column("text")[at : at + 256])
                own = np.array([langs.index(x) for x in batch.column("lang")[at : at + 256].to_pylist()], np.int64)
                parts = [(i, np.unique(h[a:b])) for i, a, b in zip(own, offsets[:-1], offsets[1:], strict=True)]
                for i in np.unique(own):
                    grams_, c = np.unique(np.concatenate([p for j, p in parts if j == i]), return_counts=True)
                    yield pa.record_batch({"lang": pa.array(np.full(len(c), i, np.int32)), "h": pa.array(grams_.view(np.int64)), "c": pa.array(c)})

    counted = sample.mapInArrow(run, "lang int, h long, c long").groupBy("lang", "h").agg(F.sum("c").alias("c"))
    least = F.array(*[F.lit(max(min(2, sizes[x]), share * min(sizes[x], bound))) for x in langs])
    # at most (n-grams of a document) / share rows a language
    for part in counted.where(F.col("c") >= F.get(least, F.col("lang"))).groupBy("lang").agg(F.collect_list("h").alias("h")).collect():
        filters.add(part.lang, np.array(part.h, np.int64).view(np.uint64))
    return filters


def identified(docs: DataFrame, **options) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row of ``docs``.

    lang_pred is the language with the most corrected hits (the first by name
    on ties), ``und`` if the text is null or has no letter or nothing was
    learned; score is its share of all corrected hits, 0 for ``und``. A text
    whose n-grams no filter has gets the
    first language by name, with score 0. held_out is null for a null doc_id. An empty table
    gives no rows; other columns are ignored.
    """
    filters = train(docs, **options)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                texts = batch.column("text")[at : at + 128]
                h, offsets = grams(texts)
                counts = filters.counts(h, offsets)
                named, score = [], []
                for x, row in zip(texts.to_pylist(), counts, strict=True):
                    if not filters.langs or not any(map(str.isalpha, x or "")):
                        named.append("und")
                        score.append(0.0)
                    else:
                        best = int(row.argmax())
                        named.append(filters.langs[best] if row[best] else filters.langs[0])
                        score.append(float(row[best] / row.sum()) if row[best] else 0.0)
                yield pa.record_batch({"doc_id": batch.column("doc_id")[at : at + 128], "held_out": batch.column("held_out")[at : at + 128], "lang_pred": pa.array(named, pa.string()), "score": pa.array(score, pa.float64())})

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2).alias("held_out"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
