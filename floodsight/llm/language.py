"""Language identification by nearest centroids.

A text becomes a vector of TF-IDF weights of its byte 2-, 3- and 4-grams, hashed into DIM places, with unit
length. Learning takes at most `per_lang` labelled texts of each language, clusters their vectors into a few
centroids by cosine. Then pieces of 1, 2, 4, ... words of the same texts and the whole texts are held against
them, which gives each centroid a limit for each length, from a low quantile of the cosines there. A text gets the
language of the nearest centroid; it is rejected if it is further away than that centroid's limit for its
length. Length is the number of different n-grams, so one word said a thousand times counts as a short text.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from floodsight.llm.frames import documents, map_texts
from floodsight.llm.text import text_bytes
from floodsight.session import settle

DIM = 4096
PER_LANG, CENTROIDS, LANGS = 300, 3, 200
QUANTILE, NEAR = 0.02, 0.8  # the limit is NEAR of this quantile of the learned pieces' cosines
FEW = 50  # pieces; with fewer, a centroid's limit comes from all of its language, or else from all languages
LENGTHS = 26  # half powers of two up to DIM
UNKNOWN = "und"
ROWS = 256  # texts at once, each with DIM counts

_PLACE = np.full(256, 32, np.uint64)  # all that is no letter counts as a space
_PLACE[[*range(65, 91), *range(97, 123), *range(128, 256)]] = [*range(65, 91), *range(97, 123), *range(128, 256)]


def gram_counts(texts: pa.Array) -> np.ndarray:
    """A row of DIM n-gram counts for each text."""
    body = text_bytes(pc.utf8_lower(texts.cast(pa.string())))
    out = np.zeros((len(texts), DIM), np.float32)
    code = _PLACE[body.data]
    text = np.repeat(np.arange(len(texts), dtype=np.int64), np.diff(body.at)) * DIM
    for size in (2, 3, 4):
        if len(code) < size:
            break
        gram = code[: len(code) - size + 1].copy()
        for k in range(1, size):
            gram = gram << np.uint64(8) | code[k : len(code) - size + 1 + k]
        bucket = ((gram * np.uint64(0x9E3779B97F4A7C15) + np.uint64(size)) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(52)).astype(np.int64)
        whole = text[: len(gram)] == text[size - 1 :]
        out += np.bincount((text[: len(gram)] + bucket)[whole], minlength=out.size).reshape(out.shape)
    return out


def has_letter(texts: pa.Array) -> np.ndarray:
    seen = pc.fill_null(pc.match_substring_regex(texts.cast(pa.string()), "[A-Za-z]"), False).to_numpy(zero_copy_only=False).copy()
    for i in np.flatnonzero(~seen):
        seen[i] = any(map(str.isalpha, texts[i].as_py() or ""))
    return seen


@dataclass
class Model:
    langs: list[str]
    lang_of: np.ndarray  # of each centroid
    centroids: np.ndarray
    idf: np.ndarray
    limit: np.ndarray  # the lowest cosine that isn't rejected, by centroid and length

    def nearest(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Language number, cosine, and whether it is too far away."""
        best, value = best_of(unit(np.log1p(counts) * self.idf) @ self.centroids.T)
        return self.lang_of[best], value, value < self.limit[best, length_of(counts)]

    def nearest_own(self, counts: np.ndarray, lang: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest centroid of the language given by number, and its cosine."""
        cosine = unit(np.log1p(counts) * self.idf) @ self.centroids.T
        return best_of(np.where(self.lang_of[None, :] == lang[:, None], cosine, -1))


def best_of(cosine: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    best = cosine.argmax(axis=1)
    return best, np.clip(cosine[np.arange(len(best)), best], 0, 1)


def length_of(counts: np.ndarray) -> np.ndarray:
    return (2 * np.log2(1 + np.count_nonzero(counts, axis=1))).astype(np.int64).clip(0, LENGTHS - 1)


def pieces(text: str) -> list[str]:
    """Runs of 1, 2, 4, ... words from places spread over the text, and all of it."""
    words = text.split()
    out, size = [text], 1
    while size < len(words):
        at = zlib.crc32(f"{size} {len(text)}".encode()) % (len(words) - size + 1)
        out.append(" ".join(words[at : at + size]))
        size *= 2
    return out


def unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-9)


def clusters(rows: np.ndarray, count: int, rounds: int = 12) -> np.ndarray:
    """Centroids by cosine; the first is the row nearest the mean, each other the one furthest from those before."""
    picked = [int((rows @ rows.mean(axis=0)).argmax())]
    for _ in range(min(count, len(rows)) - 1):
        picked.append(int((rows @ rows[picked].T).max(axis=1).argmin()))
    centres = rows[picked]
    for _ in range(rounds):
        own = (rows @ centres.T).argmax(axis=1)
        centres = unit(np.stack([rows[own == k].mean(axis=0) if (own == k).any() else centres[k] for k in range(len(centres))]))
    return centres


def fit(sample: list[tuple[str, np.ndarray]]) -> Model:
    """From (language, counts) of the sample's texts."""
    sample = [(lang, row) for lang, row in sample if row.any()]
    langs = sorted({lang for lang, _ in sample})
    if not langs:
        return Model([], np.zeros(0, np.int64), np.zeros((0, DIM), np.float32), np.ones(DIM, np.float32), np.zeros((0, LENGTHS), np.float32))
    rows, lang = np.stack([row for _, row in sample]), np.array([langs.index(x) for x, _ in sample])
    idf = (np.log((1 + len(rows)) / (1 + (rows > 0).sum(axis=0))) + 1).astype(np.float32)
    vectors = unit(np.log1p(rows) * idf)
    parts = [clusters(vectors[lang == k], CENTROIDS) for k in range(len(langs))]
    centroids, lang_of = np.concatenate(parts), np.repeat(np.arange(len(langs)), [len(x) for x in parts])
    return Model(langs, lang_of, centroids.astype(np.float32), idf, np.zeros((len(centroids), LENGTHS), np.float32))


def limits(lang_of: np.ndarray, centroid: np.ndarray, length: np.ndarray, cosine: np.ndarray) -> np.ndarray:
    """By centroid and length, from the learned pieces. A length that none has gets the limit of the next shorter one."""
    out = np.zeros((len(lang_of), LENGTHS), np.float32)
    for k in range(len(lang_of)):
        wider = (centroid == k, lang_of[centroid] == lang_of[k], np.ones(len(centroid), bool))
        for n in range(LENGTHS):
            found = [cosine[of & (length == n)] for of in wider]
            enough = [x for x in found if len(x) >= FEW]
            out[k, n] = NEAR * np.quantile(enough[0], QUANTILE) if enough else out[k, n - 1] if n else 0
    return out


def learn(docs: DataFrame, per_lang: int = PER_LANG) -> Model:
    """Learn from up to `per_lang` labelled texts of each of up to LANGS languages, none of them held out."""
    labelled = docs.where("lang IS NOT NULL AND text IS NOT NULL AND doc_id IS NOT NULL").where(~held_out(F.col("doc_id")))
    turn = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    picked = labelled.select("doc_id", "lang").withColumn("turn", F.row_number().over(turn)).where(F.col("turn") <= per_lang)
    picked = picked.orderBy("turn", "lang").limit(per_lang * LANGS).select("doc_id", "lang")
    rows = labelled.select("doc_id", "lang", "text").join(F.broadcast(picked), ["doc_id", "lang"], "left_semi").select("lang", "text")
    rows = settle(rows, "learned")

    def work(batch):
        counts = gram_counts(batch.column(1))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in counts.astype(np.float32)], pa.binary())], ["lang", "counts"])

    found = map_texts(rows, work, "lang string, counts binary", ROWS).toArrow()
    sample = sorted(zip(found["lang"].to_pylist(), found["counts"].to_pylist()))
    model = fit([(lang, np.frombuffer(row, np.float32)) for lang, row in sample])
    if model.langs:
        model.limit = limits(model.lang_of, *own_cosines(rows, model))
    return model


def own_cosines(rows: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Centroid, length and cosine of the pieces of `rows(lang, text)`."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def work(batch):
        known = shared.value
        for lang, text in zip(*(x.to_pylist() for x in batch.columns)):
            if lang not in known.langs:
                continue
            counts = gram_counts(pa.array(pieces(text)))
            counts = counts[counts.any(axis=1)]
            best, value = known.nearest_own(counts, np.full(len(counts), known.langs.index(lang)))
            yield pa.RecordBatch.from_arrays([pa.array(best), pa.array(length_of(counts)), pa.array(value.astype(np.float64))], ["centroid", "length", "cosine"])

    found = map_texts(rows, work, "centroid long, length long, cosine double", ROWS).toArrow()
    return tuple(found[name].to_numpy() for name in ("centroid", "length", "cosine"))


def held_out(doc_id):
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(5)) == 0, F.lit(False))


def _predict(texts: pa.Array, model: Model) -> tuple[list[str], np.ndarray, np.ndarray]:
    letters = has_letter(texts)
    if not model.langs:
        return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
    lang, score, far = model.nearest(gram_counts(texts))
    names = [model.langs[k] if seen else UNKNOWN for k, seen in zip(lang, letters)]
    return names, np.where(letters, score, 0.0).astype(np.float64), far | ~letters


def predictions(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected) of each row, from its text alone.

    lang_pred is `und`, score 0 and rejected true for a null text, a text without a letter, or when there was
    nothing to learn from. Of equally near centroids that of the first language by name counts. A text of any length is one
    vector of counts. A null doc_id is not held out. Repeated rows come back as often; other columns are ignored. An empty
    table gives no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batch):
        names, score, far = _predict(batch.column(2), shared.value)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(score), pa.array(far)], ["doc_id", "held_out", "lang_pred", "score", "rejected"]
        )

    return map_texts(rows, work, "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean", ROWS)


def known_language(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of `docs`, all columns, that aren't rejected (see `predictions`): null, empty and letterless texts go, and rows
    are looked at one by one, so null or repeated ids don't matter."""
    at = docs.columns.index("text")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batch):
        yield batch.filter(pa.array(~_predict(batch.column(at), shared.value)[2]))

    return map_texts(docs, work, docs.schema, ROWS)


def op3_language_id(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return predictions(docs, learn(docs))
