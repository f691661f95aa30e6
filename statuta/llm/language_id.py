"""Language ID: a byte convolutional network trained in numpy.

Bytes of a fixed-length window become symbols (the bytes that training text
uses, one symbol for all others, one for padding).  Filters of several widths
slide over the window, each keeps its largest response (max pooling), and a
softmax layer maps the responses to languages.  A text is cut into windows that
cover all its bytes; its prediction is the mean of the windows' probabilities,
weighted by their bytes.

The network is fitted on the driver from windows of about ROWS_PER_LANG training
rows of each of the MOST_LANGS commonest languages (rows are drawn by a hash of
id and text, in proportion; MOST_WINDOWS windows in all at most, the first by
that hash), so its cost does not grow with the corpus.  Scoring is one pass over
the documents without a shuffle.

Defined results: `und` with score 0.0 for a text that is null or has no letter,
and for every text when no labelled row can be learned from; rows with a null
language are never learned from; a null id counts as the empty text in the fold.
Repeated rows are scored alike.  An empty table gives an empty result.
keep_known_language() keeps whole rows, each by its own text: null ids, repeated
ids and repeated rows make no difference, and other columns stay as they are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from statuta.llm.store import arrow_rows, materialise, row_key, table, without
from statuta.llm.textkit import LOWER, text_slices

#: Labelled rows of one language that the fit uses, about; windows of each.
ROWS_PER_LANG = 600
WINDOWS_PER_ROW = 2
#: Languages that the network tells apart, the commonest ones, and windows in all: bounds of the fit.
MOST_LANGS, MOST_WINDOWS = 64, 20_000
WINDOW = 192
WIDTHS = (2, 3, 4)
FILTERS = 16
STEPS = 400
_LETTER = re.compile(r"[^\W\d_]")
#: Windows scored at once: bounds the memory of the responses.
_ROWS_AT_ONCE = 1024
#: Texts that are sent to a worker at once by the stage that keeps whole rows.
BATCH_ROWS = 500


def fold(id_col: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo modulus."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % modulus


def fold_bytes(data: np.ndarray) -> np.ndarray:
    """Lower-case A-Z and, in UTF-8, the Latin-1 capitals."""
    out = LOWER[data]
    if len(out) > 1:
        after = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        out[1:][after] += 0x20
    return out


class ByteConvNet:
    """Weights and symbols; train() fits them, probabilities() scores windows."""

    def __init__(self, langs: list[str], symbols: np.ndarray, weights: dict[str, np.ndarray]):
        self.langs, self.symbols, self.w = langs, symbols, weights
        self.tables: list | None = None

    def __getstate__(self):
        return {"langs": self.langs, "symbols": self.symbols, "w": self.w, "tables": None}

    @classmethod
    def train(cls, windows: list[bytes], labels: list[str], seed: int = 7, steps: int = STEPS) -> ByteConvNet:
        langs = sorted(set(labels))
        data = np.zeros((len(windows), WINDOW), np.uint8)
        sizes = np.array([min(len(x), WINDOW) for x in windows])
        for row, x in zip(data, windows, strict=True):
            row[: min(len(x), WINDOW)] = fold_bytes(np.frombuffer(x[:WINDOW], np.uint8))
        used = np.bincount(data[np.arange(WINDOW) < sizes[:, None]], minlength=256)
        common = np.flatnonzero(used >= max(1, used.sum() // 10_000))
        symbols = np.ones(256, np.int64)  # 0 pads, 1 is any other byte
        symbols[common] = np.arange(len(common)) + 2
        size = len(common) + 2
        x = np.where(np.arange(WINDOW) < sizes[:, None], symbols[data], 0)
        y = np.searchsorted(langs, labels)
        rng = np.random.default_rng(seed)
        w = {f"e{k}": rng.normal(0, 0.3, (k, size, FILTERS)).astype(np.float32) for k in WIDTHS}
        w |= {f"b{k}": np.zeros(FILTERS, np.float32) for k in WIDTHS}
        w |= {"d": rng.normal(0, 0.1, (FILTERS * len(WIDTHS), len(langs))).astype(np.float32), "c": np.zeros(len(langs), np.float32)}
        moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in w.items()}
        groups = [np.flatnonzero(y == k) for k in range(len(langs))]
        for step in range(1, steps + 1):
            pick = np.array([rng.choice(groups[k]) for k in rng.integers(0, len(langs), 48)])  # languages in equal shares
            xb, yb = x[pick], y[pick]
            pooled, wins = [], []
            for k in WIDTHS:
                r = sum(w[f"e{k}"][j][xb[:, j : WINDOW - k + 1 + j]] for j in range(k))
                at = r.argmax(1)
                wins.append(at)
                pooled.append(np.take_along_axis(r, at[:, None], 1)[:, 0] + w[f"b{k}"])
            raw = np.concatenate(pooled, 1)
            h = np.maximum(raw, 0)
            logits = h @ w["d"] + w["c"]
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(yb)), yb] -= 1
            p /= len(yb)
            grad = {"d": h.T @ p, "c": p.sum(0)}
            back = (p @ w["d"].T) * (raw > 0)
            for i, k in enumerate(WIDTHS):
                g = back[:, i * FILTERS : (i + 1) * FILTERS]
                grad[f"b{k}"] = g.sum(0)
                e = np.zeros_like(w[f"e{k}"])
                for j in range(k):
                    np.add.at(e[j], (np.take_along_axis(xb, wins[i] + j, 1), np.arange(FILTERS)), g)
                grad[f"e{k}"] = e
            for k, v in w.items():
                m, s = moments[k]
                m += 0.1 * (grad[k] - m)
                s += 0.001 * (grad[k] ** 2 - s)
                v -= 0.02 * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
        return cls(langs, symbols, w)

    def _pairs(self) -> list:
        """Each filter bank as sums of tables over one or two symbols."""
        if self.tables is None:
            size = self.w["e2"].shape[1]
            self.tables = []
            for k in WIDTHS:
                e, parts = self.w[f"e{k}"], []
                for j in range(0, k - 1, 2):
                    parts.append((j, True, (e[j][:, None] + e[j + 1][None]).reshape(size * size, FILTERS)))
                if k % 2:
                    parts.append((k - 1, False, e[k - 1]))
                self.tables.append((k, parts))
        return self.tables

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """Of each window of symbols, a probability for each language."""
        size = self.w["e2"].shape[1]
        pair = x[:, :-1] * size + x[:, 1:]
        pooled = []
        for k, parts in self._pairs():
            width = x.shape[1] - k + 1
            r = None
            for j, two, t in parts:
                got = t[(pair if two else x)[:, j : j + width]]
                r = got if r is None else np.add(r, got, out=r)
            pooled.append(r.max(1) + self.w[f"b{k}"])
        logits = np.maximum(np.concatenate(pooled, 1), 0) @ self.w["d"] + self.w["c"]
        p = np.exp(logits - logits.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)

    def score_slice(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Mean probabilities of each text of a slice; zeros for an empty one."""
        rows = len(offsets) - 1
        sizes = np.diff(offsets)
        n = -(-sizes // WINDOW)
        total = int(n.sum())
        row = np.repeat(np.arange(rows), n)
        start = offsets[:-1][row] + (np.arange(total) - np.repeat(np.cumsum(n) - n, n)) * WINDOW
        size = np.minimum(offsets[1:][row] - start, WINDOW)
        padded = np.concatenate([self.symbols[fold_bytes(data)], np.zeros(WINDOW, np.int64)])
        out = np.zeros((rows, len(self.langs)))
        for i in range(0, total, _ROWS_AT_ONCE):
            s, z = start[i : i + _ROWS_AT_ONCE], size[i : i + _ROWS_AT_ONCE]
            x = padded[s[:, None] + np.arange(WINDOW)]
            x[np.arange(WINDOW) >= z[:, None]] = 0
            np.add.at(out, row[i : i + _ROWS_AT_ONCE], self.probabilities(x) * z[:, None])
        return out / np.maximum(sizes, 1)[:, None]


def has_letters(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether each text of a slice has a letter of any script."""
    letters = np.concatenate([[0], np.cumsum((LOWER[data] >= 97) & (LOWER[data] <= 122))])
    found = letters[offsets[1:]] > letters[offsets[:-1]]
    for k in np.flatnonzero(~found & (np.diff(offsets) > 0)):
        found[k] = bool(_LETTER.search(data[offsets[k] : offsets[k + 1]].tobytes().decode("utf-8", "replace")))
    return found


def training_windows(docs: DataFrame, id_col: str, text_col: str, lang_col: str, rows_per_lang: int = ROWS_PER_LANG) -> DataFrame:
    """(place, lang, window) of about rows_per_lang rows of each of the commonest languages."""
    known = docs.where(F.col(lang_col).isNotNull() & (F.length(F.trim(F.col(text_col))) > 0))
    counts = known.groupBy(F.col(lang_col).alias("of")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "of").limit(MOST_LANGS).collect()
    place = F.pmod(F.xxhash64(F.col(id_col), F.col(text_col), F.lit(11)), F.lit(1 << 30))
    share = F.create_map(*[F.lit(x) for r in counts for x in (r.of, min(1.0, rows_per_lang / r.n))]) if counts else F.create_map().cast("map<string,double>")
    drawn = known.where(place < F.try_element_at(share, F.col(lang_col)) * float(1 << 30))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places, langs, windows = [], [], []
            for place, lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                raw = text.as_py().encode()
                rng = np.random.default_rng(len(raw))
                for s in rng.integers(0, max(1, len(raw) - WINDOW + 1), WINDOWS_PER_ROW):
                    places.append(place)
                    langs.append(lang)
                    windows.append(raw[s : s + WINDOW])
            yield pa.RecordBatch.from_pydict({"place": pa.array(places, pa.int64()), "lang": pa.array(langs, pa.string()), "window": pa.array(windows, pa.binary())})

    return drawn.select(place.alias("place"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).mapInArrow(cut, "place long, lang string, window binary")


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> ByteConvNet | None:
    """The network learned from labelled rows; None without any."""
    drawn = training_windows(docs, id_col, text_col, lang_col).orderBy("place", "lang", "window").limit(MOST_WINDOWS)
    rows = sorted((r.lang, bytes(r.window)) for r in drawn.collect())
    return ByteConvNet.train([w for _, w in rows], [lang for lang, _ in rows]) if rows else None


def told(net: ByteConvNet | None, texts: pa.Array) -> tuple[list[str], list[float]]:
    """Language and score of each text."""
    langs: list[str] = []
    scores: list[float] = []
    for _, rows, data, offsets in text_slices(texts):
        if net is None:
            langs += ["und"] * rows
            scores += [0.0] * rows
            continue
        p, ok = net.score_slice(data, offsets), has_letters(data, offsets)
        langs += [net.langs[b] if k else "und" for b, k in zip(p.argmax(1), ok, strict=True)]
        scores += np.where(ok, np.clip(p.max(1), 0, 1), 0.0).tolist()
    return langs, scores


def predict(docs: DataFrame, net: ByteConvNet | None, text_col: str, keep: list[Column]) -> DataFrame:
    """keep, lang_pred and score of every row of docs."""
    chosen = docs.select(F.col(text_col).alias("scored_text"), *keep)
    schema = docs.select(*keep, F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores = told(net, batch.column(0))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*batch.schema.names[1:], "lang_pred", "score"])

    return chosen.mapInArrow(task, schema)


def language_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score; rows of fold 2 of 4 are held out."""
    held = (fold(id_col, 4) == 2).alias("held_out")
    net = fit(docs.where(fold(id_col, 4) != 2), id_col, text_col, lang_col)
    return predict(docs, net, text_col, [F.col(id_col).alias("doc_id"), held])


def op5_byte_convnet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(table(spark, sf_dir, "documents"))


def keep_known_language(docs: DataFrame, least_score: float = 0.4) -> DataFrame:
    """The rows of docs whose language is recognised; all columns stay.  Each text is sent once, and only keys come back:
    those of the other rows are written first, so few of them cost no shuffle of texts."""
    net = fit(docs.where(fold("doc_id", 4) != 2))
    if net is None:
        return docs.where(F.lit(False))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores = told(net, batch.column(1))
            dropped = [lang == "und" or s < least_score for lang, s in zip(langs, scores, strict=True)]
            yield batch.select(["unknown"]).filter(pa.array(dropped, pa.bool_()))

    with arrow_rows(docs.sparkSession, BATCH_ROWS):
        unknown = materialise(docs.select(row_key(docs).alias("unknown"), "text").mapInArrow(task, "unknown long").distinct(), "unknown-language")
    return without(docs, unknown)


QUERIES = {"op5_byte_convnet": op5_byte_convnet}
ORACLES: dict[str, str] = {}
