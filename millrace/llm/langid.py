"""Language of words, spans and documents.

Words are runs of letters. The scripts of a word (by code point ranges) leave the
languages that the training text shows in that script; among them every word is
scored by character trigrams, and a Viterbi pass over the words with a penalty for
each change of language labels spans. A document's language is the one that holds
most letters of its path.

``train`` counts trigrams and scripts over all training rows in Spark; the model
holds one number per language and trigram slot, so it does not grow with the rows.
``predict`` scores whole texts in slices; equal words of a slice are scored once.

Null texts and texts without a letter give ``und`` with score 0. Texts that tie
take the first language by code point. Rows that repeat get equal results. Without
training rows every text is ``und``. Columns other than id and text are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytetext

SLOTS = 1 << 16
#: Cost of a change of language, in natural logs.
SWITCH = 6.0
#: A word adds at most so much per language, so that one odd word cannot decide.
WORD_CAP = 8.0

#: First and last code point of the letters of a script.
SCRIPTS = [
    ("latin", 0x41, 0x24F), ("latin", 0x1E00, 0x1EFF), ("greek", 0x370, 0x3FF), ("cyrillic", 0x400, 0x52F),
    ("armenian", 0x530, 0x58F), ("hebrew", 0x590, 0x5FF), ("arabic", 0x600, 0x6FF), ("arabic", 0x750, 0x77F),
    ("devanagari", 0x900, 0x97F), ("bengali", 0x980, 0x9FF), ("tamil", 0xB80, 0xBFF), ("thai", 0xE00, 0xE7F),
    ("georgian", 0x10A0, 0x10FF), ("hangul", 0x1100, 0x11FF), ("kana", 0x3040, 0x30FF), ("han", 0x3400, 0x9FFF),
    ("hangul", 0xAC00, 0xD7AF),
]
_NAMES = sorted({s for s, _, _ in SCRIPTS}) + ["other"]


def _letters() -> np.ndarray:
    """Bytes of words: ASCII letters, and bytes of characters past U+007F."""
    table = np.zeros(256, bool)
    table[[*range(65, 91), *range(97, 123)]] = True
    table[128:] = True
    return table


_TABLE = _letters()


def word_rows(data: np.ndarray, off: np.ndarray):
    """Words of lower-cased texts: (data, off, start, end, owner), only those with a letter.

    A run of bytes past U+007F may hold signs only (dashes, quotes); such runs are dropped.
    """
    data, off = bytetext.lower(data, off)
    start, end, owner = bytetext.words(data, off, _TABLE)
    ascii_letter = np.zeros(len(data) + 1, np.int32)
    np.cumsum(data < 128, out=ascii_letter[1:])
    high = np.flatnonzero(ascii_letter[end] == ascii_letter[start])
    if len(high):
        raw = data.tobytes()
        drop = [k for k in high.tolist() if not any(c.isalpha() for c in raw[start[k]: end[k]].decode("utf-8", "replace"))]
        start, end, owner = (np.delete(x, drop) for x in (start, end, owner))
    return data, off, start, end, owner


def trigrams(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word number, slot) of every byte trigram of each word with a blank on both sides."""
    size = end - start
    length = size + 2
    ends = np.cumsum(length)
    flat = np.full(int(length.sum()), 32, np.uint32)
    inner = np.ones(len(flat), bool)
    inner[ends - 1] = inner[ends - length] = False
    flat[inner] = data[bytetext.spread(start, size)]
    word = np.repeat(np.arange(len(start)), size)
    begin = bytetext.spread(ends - length, size)
    slot = flat[begin] * np.uint32(0x9E3779B1) ^ flat[begin + 1] * np.uint32(0x85EBCA6B) ^ flat[begin + 2] * np.uint32(0xC2B2AE35)
    slot ^= slot >> np.uint32(15)
    return word, ((slot * np.uint32(0x2C1B3C6D)) >> np.uint32(16)).astype(np.int64)


def scripts(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Bit set of the scripts of each word (bit = place in the sorted names)."""
    latin = 1 << _NAMES.index("latin")
    lead = np.zeros(len(data) + 1, np.int32)
    # Lead bytes from 0xC9 on begin characters past U+023F.
    np.cumsum(data >= 0xC9, out=lead[1:])
    out = np.full(len(start), latin, np.int64)
    far = np.flatnonzero(lead[end] > lead[start])
    if len(far):
        raw = data.tobytes()
        for k in far.tolist():
            bits = 0
            for c in raw[start[k]: end[k]].decode("utf-8", "replace"):
                if c.isalpha():
                    name = next((s for s, a, b in SCRIPTS if a <= ord(c) <= b), "other")
                    bits |= 1 << _NAMES.index(name)
            out[k] = bits or latin
    return out


class Model:
    """Log odds of each slot by language, and the scripts a language is written in."""

    def __init__(self, langs: list[str], counts: np.ndarray, script_counts: np.ndarray):
        self.langs = langs
        self.odds, self.allowed = np.zeros((SLOTS, 0), np.float32), np.zeros(0, np.int64)
        if not langs:
            return
        total = counts.sum(1, keepdims=True) + 0.5 * SLOTS
        logp = np.log((counts + 0.5) / total)
        # Slots that no language has seen say nothing.
        logp[:, counts.sum(0) == 0] = 0
        self.odds = (logp - logp.mean(0)).astype(np.float32).T.copy()
        share = script_counts / np.maximum(1, script_counts.sum(1, keepdims=True))
        self.allowed = np.array([sum(1 << int(k) for k in np.flatnonzero(s >= 0.001)) for s in share], np.int64)

    def parts(self) -> tuple:
        """What tasks need, as arrays: they read it without a copy of the package."""
        return self.langs, self.odds, self.allowed

    @classmethod
    def again(cls, parts: tuple) -> Model:
        model = cls([], None, None)
        model.langs, model.odds, model.allowed = parts
        return model

    def words(self, data, start, end) -> np.ndarray:
        """Score of each word in each language; languages of other scripts are out of
        reach, unless no language has the script."""
        word, slot = trigrams(data, start, end)
        score = np.empty((len(start), len(self.langs)), np.float32)
        for k in range(len(self.langs)):
            score[:, k] = np.bincount(word, weights=self.odds[slot, k], minlength=len(start))
        score -= score.max(1, keepdims=True)
        np.maximum(score, -WORD_CAP, out=score)
        bits = scripts(data, start, end)
        fits = (bits[:, None] & self.allowed[None, :]) != 0
        fits |= ~fits.any(1, keepdims=True)
        score[~fits] = -2 * WORD_CAP
        return score


def viterbi(score: np.ndarray, first: np.ndarray, count: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """Best language of each word; texts are runs ``first[i] .. first[i]+count[i]``.

    All texts go forward together, a word a step, longest first, so a step is one
    operation on the texts that still have words.
    """
    n, width = score.shape
    path = np.zeros(n, np.int8 if width < 128 else np.int32)
    order = np.argsort(-count, kind="stable")
    first, count = first[order], count[order]
    first, count = first[count > 0], count[count > 0]
    if not len(count):
        return path
    active = np.searchsorted(-count, -np.arange(count[0]), "left")
    switched, back = np.zeros((n, width), bool), np.zeros(n, path.dtype)
    state = score[first].copy()
    for step in range(1, int(count[0])):
        live = active[step]
        here = first[:live] + step
        old = state[:live]
        best = old.argmax(1)
        top = old[np.arange(live), best] - np.float32(switch)
        go = old < top[:, None]
        back[here] = best
        switched[here] = go
        state[:live] = np.where(go, top[:, None], old) + score[here]
    cur = np.zeros(len(count), np.int64)
    for step in range(int(count[0]) - 1, -1, -1):
        live = active[step]
        ends = count[:live] == step + 1
        cur[:live][ends] = state[:live][ends].argmax(1)
        here = first[:live] + step
        path[here] = cur[:live]
        if step:
            cur[:live] = np.where(switched[here, cur[:live]], back[here], cur[:live])
    return path


def train(df: DataFrame, text: str = "text", lang: str = "lang", max_rows: int | None = None, id_col: str | None = None) -> Model:
    """Counts over the rows with a language.

    ``max_rows`` bounds the sample of each language, drawn by a hash of ``id_col`` (of the
    text where it is null or not given): a language with fewer rows keeps all of them.
    """
    import pyarrow as pa

    key = F.col(text) if id_col is None else F.coalesce(F.col(id_col).cast("string"), F.col(text))
    rows = df.select(F.col(text).alias("text"), F.col(lang).alias("lang"), F.pmod(F.xxhash64(key), F.lit(1 << 20)).alias("spot"))
    rows = rows.filter("text IS NOT NULL AND lang IS NOT NULL")
    if max_rows is not None:
        # A row per language, as the model has.
        seen = rows.groupBy("lang").agg(F.count("*").alias("n")).collect()
        bound = F.lit(0)
        for r in seen:
            bound = F.when(F.col("lang") == r["lang"], F.lit(int((1 << 20) * min(1.0, max_rows / r["n"])))).otherwise(bound)
        rows = rows.filter(F.col("spot") < bound)
    rows = rows.select("text", "lang")

    def counted(batches):
        total: dict[str, np.ndarray] = {}
        for (langs,), data, off in bytetext.slices(batches, ["lang"], "text"):
            data, off, start, end, owner = word_rows(data, off)
            names = np.array(langs.to_pylist(), object)
            for name in set(names.tolist()):
                mine = names[owner] == name if len(owner) else np.zeros(0, bool)
                mine = mine.astype(bool)
                have = total.setdefault(name, np.zeros(SLOTS + 64, np.int64))
                _, slot = trigrams(data, start[mine], end[mine])
                have[:SLOTS] += np.bincount(slot, minlength=SLOTS)
                bits, n = np.unique(scripts(data, start[mine], end[mine]), return_counts=True)
                for b, c in zip(bits.tolist(), n.tolist()):
                    for k in range(len(_NAMES)):
                        have[SLOTS + k] += c * (b >> k & 1)
        for name, have in total.items():
            used = np.flatnonzero(have)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(used), pa.string()), pa.array(used, pa.int32()), pa.array(have[used], pa.int64())], ["lang", "slot", "n"])

    found = rows.mapInArrow(counted, "lang string, slot int, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(found["lang"].unique())
    grid = np.zeros((len(langs), SLOTS + 64))
    if langs:
        grid[np.searchsorted(np.array(langs, object), found["lang"].to_numpy(object)), found["slot"].to_numpy(int)] = found["n"]
    return Model(langs, grid[:, :SLOTS], grid[:, SLOTS:])


def label_slice(model: Model, data: np.ndarray, off: np.ndarray):
    """(data, start, end, owner, path): words and their languages."""
    import pandas as pd

    data, off, start, end, owner = word_rows(data, off)
    if not len(start) or not model.langs:
        return data, start, end, owner, np.zeros(len(start), np.int8)
    code, _ = pd.factorize(bytetext.span_hashes(data, start, end))
    first = np.zeros(code.max() + 1, np.int64)
    first[code[::-1]] = np.arange(len(code) - 1, -1, -1)
    score = model.words(data, start[first], end[first])[code]
    count = np.bincount(owner, minlength=len(off) - 1)
    return data, start, end, owner, viterbi(score, np.cumsum(count) - count, count)


def predict(df: DataFrame, model: Model, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: id, lang_pred and score, the share of letters that the path gives to it."""
    import pyarrow as pa

    sent = df.sparkSession.sparkContext.broadcast(model.parts())

    def labelled(batches):
        model = Model.again(sent.value)
        names = np.array([*model.langs, "und"], object)
        for (ids,), data, off in bytetext.slices(batches, [id_col], "text"):
            data, start, end, owner, path = label_slice(model, data, off)
            n, width = len(off) - 1, max(1, len(model.langs))
            held = np.bincount(owner * width + path, weights=end - start, minlength=n * width).reshape(n, width)
            total, best = held.sum(1), held.argmax(1)
            known = (total > 0) & bool(model.langs)
            yield pa.RecordBatch.from_arrays([
                ids, pa.array(names[np.where(known, best, len(model.langs))], pa.string()),
                pa.array(np.where(known, held.max(1) / np.maximum(total, 1), 0.0))], [id_col, "lang_pred", "score"])

    rows = df.select(id_col, F.col(text).alias("text"))
    return rows.mapInArrow(labelled, f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, lang_pred string, score double")


def spans(df: DataFrame, model: Model, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Runs of words of one language: id, span, lang, n_words, and the first and last
    byte of the run in the lower-cased UTF-8 text."""
    import pyarrow as pa

    sent = df.sparkSession.sparkContext.broadcast(model.parts())

    def labelled(batches):
        model = Model.again(sent.value)
        for (ids,), data, off in bytetext.slices(batches, [id_col], "text"):
            if not model.langs:
                continue
            low, start, end, owner, path = label_slice(model, data, off)
            base = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(off) - 1))])
            runs = bytetext.runs_of(owner * len(model.langs) + path)
            stop = np.append(runs[1:], len(path))
            low_off = bytetext.lower(data, off)[1]
            yield pa.RecordBatch.from_arrays([
                ids.take(pa.array(owner[runs])), pa.array(runs - base[owner[runs]], pa.int64()),
                pa.array(np.array(model.langs, object)[path[runs]], pa.string()), pa.array(stop - runs, pa.int64()),
                pa.array(start[runs] - low_off[owner[runs]], pa.int64()), pa.array(end[stop - 1] - low_off[owner[runs]], pa.int64())],
                [id_col, "first_word", "lang", "n_words", "first_byte", "end_byte"])

    rows = df.select(id_col, F.col(text).alias("text"))
    kind = df.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(labelled, f"`{id_col}` {kind}, first_word long, lang string, n_words long, first_byte long, end_byte long")
