"""Language ID of mixed-language text.

The script of a word's letters narrows the candidate languages to those learned
with that script. Each word gets a score for each candidate from letter
trigrams; a Viterbi pass over the words with a penalty for each switch labels
spans. Texts are decoded side by side, one step for the words of equal place,
so that the pass is vectorised over texts.
"""

from __future__ import annotations

import re
import uuid
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placekeep.llm.common import is_held_out, map_rows, worker_state
from placekeep.session import ship_package

#: Learned rows of each language, at most about; chosen by a hash of the id.
TRAIN_DOCS = 3_000
#: Rows of the hashed trigram table.
BUCKETS = 1 << 16
#: Cost of a change of language, in nats.
SWITCH = 12.0
#: Share of a language's learned letters from which a script counts as its own.
SCRIPT_SHARE = 0.02
#: Part of a word's trigram evidence that counts (neighbours overlap).
EVIDENCE = 0.5
#: Words that are decoded together, at least (whole texts).
GROUP = 300_000
#: Words remembered by a worker, and scored at a time.
KNOWN, LEARNED = 300_000, 20_000

UND = "und"

#: First code points of script blocks and their names.
SCRIPTS = (
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"),
    (0x0600, "arabic"), (0x0700, "syriac"), (0x0750, "arabic"), (0x0780, "thaana"), (0x0900, "devanagari"),
    (0x0980, "bengali"), (0x0A00, "gurmukhi"), (0x0A80, "gujarati"), (0x0B00, "oriya"), (0x0B80, "tamil"),
    (0x0C00, "telugu"), (0x0C80, "kannada"), (0x0D00, "malayalam"), (0x0D80, "sinhala"), (0x0E00, "thai"),
    (0x0E80, "lao"), (0x0F00, "tibetan"), (0x1000, "myanmar"), (0x10A0, "georgian"), (0x1100, "hangul"),
    (0x1200, "ethiopic"), (0x13A0, "cherokee"), (0x1400, "other"), (0x1780, "khmer"), (0x1800, "mongolian"),
    (0x18B0, "other"), (0x1C80, "cyrillic"), (0x1C90, "georgian"), (0x1CC0, "other"), (0x1D00, "latin"),
    (0x1F00, "greek"), (0x2000, "other"), (0x2C60, "latin"), (0x2C80, "other"), (0x2DE0, "cyrillic"),
    (0x2E00, "other"), (0x2E80, "han"), (0x3040, "kana"), (0x3100, "bopomofo"), (0x3130, "hangul"),
    (0x3190, "other"), (0x31F0, "kana"), (0x3200, "other"), (0x3400, "han"), (0xA000, "other"),
    (0xA640, "cyrillic"), (0xA6A0, "other"), (0xA720, "latin"), (0xA800, "other"), (0xAC00, "hangul"),
    (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "latin"), (0xFB1D, "hebrew"), (0xFB50, "arabic"),
    (0xFE00, "other"), (0xFE70, "arabic"), (0xFF00, "latin"), (0xFF66, "kana"), (0xFFA0, "hangul"), (0x10000, "other"), (0x20000, "han"),
)
NAMES = sorted({n for _, n in SCRIPTS})
_STARTS = np.array([a for a, _ in SCRIPTS], np.int64)
_NUMBER = np.array([NAMES.index(n) for _, n in SCRIPTS], np.int64)
_WORD = re.compile(r"[^\W\d_]+")
_NEVER = -1e4


def words_of(text: str | None) -> list[str]:
    """Lower-cased runs of letters."""
    return [w for w in _WORD.findall(text.lower()) if w.isalpha() or any(c.isalpha() for c in w)] if text else []


def _points(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the words, each with a space before and one after the last, and the words' starts there."""
    line = " " + " ".join(words) + " "
    points = np.frombuffer(line.encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    return points, np.cumsum(np.append(0, sizes + 1))


def _trigrams(points: np.ndarray) -> np.ndarray:
    """Bucket of the trigram around each point but the first and last."""
    code = points[:-2] * 0x9E3779B1 + points[1:-1] * 0x85EBCA77 + points[2:] * 0xC2B2AE3D
    return ((code ^ (code >> 15)) * 0x27D4EB2F >> 8) & (BUCKETS - 1)


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Trigram buckets in order, first trigram of each word, and each word's main script."""
    points, starts = _points(words)
    grams = _trigrams(points)
    script = _NUMBER[np.searchsorted(_STARTS, points, "right") - 1]
    size = np.diff(starts) - 1
    count = np.zeros((len(words), len(NAMES)), np.int32)
    owner = np.repeat(np.arange(len(words)), size)
    place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(starts[:-1] + 1, size)
    np.add.at(count, (owner, script[place]), 1)
    return grams, starts, count.argmax(1)


class Model(NamedTuple):
    langs: list[str]
    table: np.ndarray
    allowed: np.ndarray


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", train_docs: int = TRAIN_DOCS) -> Model:
    """Trigram log-probabilities and scripts of each language, from a bounded sample.

    Rows whose id is held out, and those with null text or language, are not
    used. What comes to the driver is the hashed trigram table.
    """
    known = docs.where(~is_held_out(F.col(id_col)) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    sizes = {r[0]: r[1] for r in known.groupBy(lang_col).count().collect()}
    langs = sorted(sizes)
    if not langs:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros((len(NAMES), 0), bool))
    share = F.create_map(*[F.lit(x) for n in langs for x in (n, min(1_000_000, 1_000_000 * train_docs // sizes[n] + 1))])
    sample = known.where(F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.lit(1_000_000)) < share[F.col(lang_col)])

    def count(batch: pa.RecordBatch) -> list:
        out: dict[tuple[str, int, int], int] = {}
        grams: dict[str, np.ndarray] = {}
        scripts: dict[str, np.ndarray] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            words = words_of(text.as_py())
            if words:
                g, _, s = features(words)
                grams.setdefault(lang, np.zeros(BUCKETS, np.int64))[:] += np.bincount(g, minlength=BUCKETS)
                scripts.setdefault(lang, np.zeros(len(NAMES), np.int64))[:] += np.bincount(s, minlength=len(NAMES))
        for kind, group in ((0, grams), (1, scripts)):
            for lang, total in group.items():
                out |= {(lang, kind, int(k)): int(total[k]) for k in np.flatnonzero(total)}
        return [[k[0] for k in out], [k[1] for k in out], [k[2] for k in out], list(out.values())]

    counted = map_rows(sample.select(lang_col, text_col), count, "lang string, kind int, code int, n long")
    rows = counted.groupBy("lang", "kind", "code").agg(F.sum("n").alias("n")).collect()
    grams, scripts = np.zeros((BUCKETS, len(langs))), np.zeros((len(NAMES), len(langs)))
    place = {n: i for i, n in enumerate(langs)}
    for r in rows:
        (scripts if r.kind else grams)[r.code, place[r.lang]] = r.n
    table = np.log((grams + 0.05) / (grams.sum(0) + 0.05 * BUCKETS)) * EVIDENCE
    return Model(langs, table.astype(np.float32), scripts >= np.maximum(1, SCRIPT_SHARE * scripts.sum(0)))


class Decoder:
    """Scores of the words seen by this worker, and the Viterbi pass. The last state is ``und``."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.forget()

    def forget(self) -> None:
        self.rows: dict[str, int] = {}
        self.scores = np.zeros((0, len(self.model.langs) + 1), np.float32)

    def learn(self, words: list[str]) -> None:
        """Scores of new words, a bounded number at a time."""
        parts = [self.score(words[at : at + LEARNED]) for at in range(0, len(words), LEARNED)]
        self.scores = np.concatenate([self.scores, *parts])

    def score(self, words: list[str]) -> np.ndarray:
        grams, starts, script = features(words)
        sums = np.concatenate([np.zeros((1, len(self.model.langs))), np.cumsum(self.model.table[grams], axis=0, dtype=np.float64)])
        # A word's trigrams are those around its letters.
        score = sums[starts[1:] - 1] - sums[starts[:-1]]
        allowed = self.model.allowed[script]
        none = ~allowed.any(1)
        score = np.where(allowed, score, _NEVER)
        return np.column_stack([score, np.where(none, 0.0, _NEVER)]).astype(np.float32)

    def decode(self, texts: list[list[str]]) -> list[np.ndarray]:
        """State of each word of each text."""
        if len(self.rows) > KNOWN:
            self.forget()
        rows, known = self.rows, len(self.rows)
        flat = np.fromiter((rows.setdefault(w, len(rows)) for words in texts for w in words), np.int64)
        self.learn(list(rows)[known:])
        size = np.array([len(w) for w in texts], np.int64)
        first = np.cumsum(size) - size
        order = np.argsort(-size, kind="stable")
        start, sorted_size = first[order], size[order]
        n_states = self.scores.shape[1]
        came = np.zeros((len(flat), n_states), bool)
        source = np.zeros(len(flat), np.int16)
        longest = int(size.max(initial=0))
        active = len(texts) - np.searchsorted(sorted_size[::-1], np.arange(longest), "right")
        value = np.zeros((len(texts), n_states))
        final = np.zeros(len(texts), np.int64)
        for t in range(longest):
            n = active[t]
            at = start[:n] + t
            v = value[:n]
            best = v.argmax(1)
            source[at] = best
            switch = (v[np.arange(n), best] - SWITCH)[:, None]
            if t:
                came[at] = switch > v
                np.maximum(v, switch, out=v)
            v += self.scores[flat[at]]
        if len(texts):
            final = value.argmax(1)
        states = np.zeros(len(flat), np.int64)
        state = final.copy()
        for t in range(longest - 1, -1, -1):
            n = active[t]
            at = start[:n] + t
            s = state[:n]
            states[at] = s
            state[:n] = np.where(came[at, s], source[at], s)
        return [states[a : a + n] for a, n in zip(first, size)]

    def label(self, texts: list[str | None]) -> list[tuple[str, float, list[dict]]]:
        """Language, score and spans of each text."""
        names = [*self.model.langs, UND]
        out: list[tuple[str, float, list[dict]]] = []
        for words_group in _groups(texts):
            for words, states in zip(words_group, self.decode(words_group), strict=True):
                if not words or len(names) == 1:
                    out.append((UND, 0.0, []))
                    continue
                letters = np.bincount(states, np.fromiter(map(len, words), np.int64, len(words)), len(names))
                best = int(letters[:-1].argmax())
                edges = np.flatnonzero(np.diff(states)) + 1
                spans = [{"lang": names[states[a]], "first_word": int(a), "n_words": int(b - a)} for a, b in zip([0, *edges], [*edges, len(states)])]
                out.append((names[best], float(letters[best] / letters.sum()), spans))
        return out


def _groups(texts: list[str | None]):
    group: list[list[str]] = []
    total = 0
    for text in texts:
        group.append(words_of(text))
        total += len(group[-1])
        if total >= GROUP:
            yield group
            group, total = [], 0
    if group:
        yield group


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, held_out, lang_pred, score, spans for each row.

    ``lang_pred`` is the learned language with most letters, ``score`` its
    share of them. Null texts, texts without a letter, and any text where
    nothing was learned give ``und`` and 0. Texts in scripts of no learned
    language get a learned language with score 0. Ties go to the language
    first in order. Repeated rows are kept, other columns ignored.
    """
    ship_package(docs.sparkSession)
    key, shared = uuid.uuid4().hex, docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> list:
        found = worker_state(key, lambda: Decoder(shared.value)).label(batch.column(2).to_pylist())
        return [batch.column(0), batch.column(1), [x[0] for x in found], [x[1] for x in found], [x[2] for x in found]]

    kind = dict(docs.dtypes)[id_col]
    schema = f"`{id_col}` {kind}, held_out boolean, lang_pred string, score double, spans array<struct<lang:string,first_word:long,n_words:long>>"
    return map_rows(docs.select(id_col, is_held_out(F.col(id_col)).alias("held_out"), text_col), run, schema)


def keep_identified(docs: DataFrame, model: Model, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """Rows of ``docs``, with all their columns, whose text has one learned language for at least ``least`` of its letters."""
    ship_package(docs.sparkSession)
    key, shared = uuid.uuid4().hex, docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = worker_state(key, lambda: Decoder(shared.value)).label(batch.column(at).to_pylist())
        return batch.filter(pa.array([x[0] != UND and x[1] >= least for x in found], pa.bool_()))

    return map_rows(docs, run, docs.schema)
