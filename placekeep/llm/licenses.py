"""License scans: exact base phrases, and fuzzy search for short notices.

A text becomes words over ASCII letters, ASCII digits and all bytes from 0x80,
in lower case, joined by single spaces. Base phrases are counted exactly. For a
notice with up to k edits the pigeonhole principle holds: of k + 1 pieces of it,
one stands unchanged in each occurrence. One automaton finds all pieces of all
notices in one pass; only the windows around them are matched, with the regex
library's bounded-error matching, which gives spans and edits.
"""

from __future__ import annotations

from functools import lru_cache
from typing import NamedTuple

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from placekeep.llm.common import map_rows


class Notice(NamedTuple):
    """A short notice in normal form, found with up to ``edits`` inserted, deleted or replaced bytes."""

    label: str
    text: str
    edits: int


#: Stated base phrases and labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Notices of the fuzzy search, in normal form.
NOTICES = (
    Notice("agpl-3.0", "gnu affero general public license version 3", 3),
    Notice("apache-2.0", "licensed under the apache license version 2 0", 3),
    Notice("bsd", "redistribution and use in source and binary forms with or without modification are permitted", 5),
    Notice("cc-by-nc", "licensed under cc by nc", 1),
    Notice("cc-by-sa", "licensed under cc by sa", 1),
    Notice("cc0-1.0", "cc0 1 0 universal public domain dedication", 3),
    Notice("gpl-2.0", "gnu general public license version 2", 2),
    Notice("gpl-3.0", "gnu general public license version 3", 2),
    Notice("lgpl", "gnu lesser general public license", 2),
    Notice("mit", "released under the mit license", 2),
    Notice("mit", "permission is hereby granted free of charge to any person obtaining a copy", 5),
    Notice("mpl-2.0", "mozilla public license version 2 0", 2),
    Notice("proprietary", "no part of this publication may be reproduced", 3),
    Notice("public-domain", "released into the public domain", 2),
)

_WORD = {*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)}
_TABLE = bytes(b if b in _WORD else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def normal_words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8").translate(_TABLE).split()


def pieces(notice: Notice) -> list[tuple[int, str]]:
    """Offset and text of the ``edits + 1`` pieces."""
    n, k = len(notice.text), notice.edits + 1
    cuts = [n * i // k for i in range(k + 1)]
    return [(a, notice.text[a:b]) for a, b in zip(cuts, cuts[1:])]


@lru_cache(maxsize=4)
def _compiled(notices: tuple[Notice, ...]) -> tuple:
    seeds: dict[str, list[tuple[int, int]]] = {}
    for i, notice in enumerate(notices):
        for offset, piece in pieces(notice):
            seeds.setdefault(piece, []).append((i, offset))
    automaton = ahocorasick.Automaton()
    for piece, uses in seeds.items():
        automaton.add_word(piece, (len(piece), uses))
    if seeds:
        automaton.make_automaton()
    return automaton, [regex.compile(rf"(?e)(?<= )(?:{regex.escape(n.text, literal_spaces=True)}){{e<={n.edits}}}(?= )") for n in notices]


def find_notices(line: str, notices: tuple[Notice, ...]) -> list[tuple[int, int, int, int]]:
    """Notice number, start, end and edits of each occurrence in ``line``, normal text with a space at either end."""
    automaton, patterns = _compiled(notices)
    windows: dict[int, list[list[int]]] = {}
    if len(automaton):
        for end, (size, uses) in automaton.iter(line):
            for i, offset in uses:
                k = notices[i].edits
                begin = max(0, end + 1 - size - offset - k - 1)
                until = min(len(line), end + 1 - size - offset + len(notices[i].text) + k + 1)
                own = windows.setdefault(i, [])
                if own and begin <= own[-1][1]:
                    own[-1][1] = max(own[-1][1], until)
                    own[-1][0] = min(own[-1][0], begin)
                else:
                    own.append([begin, until])
    found = []
    for i, own in windows.items():
        last = -1
        for begin, until in own:
            for m in patterns[i].finditer(line, begin, until):
                if m.start() > last:
                    found.append((i, m.start(), m.end(), sum(m.fuzzy_counts)))
                    last = m.start()
    return sorted(found, key=lambda x: (x[1], x[0]))


def scan(text: str | None, notices: tuple[Notice, ...] = NOTICES) -> tuple:
    words = normal_words(text)
    line = b" " + b" ".join(words) + b" "
    places, base = [], set()
    for phrase, label in BASE.items():
        wanted = f" {phrase} ".encode()
        at = line.find(wanted)
        while at >= 0:
            places.append(at)
            base.add(label)
            at = line.find(wanted, at + 1)
    # Bytes as code points of one byte each: spans and edits are counted in bytes.
    found = find_notices(line.decode("latin-1"), notices)
    # Each word has one space before it: its number is that of the spaces before.
    spaces = np.flatnonzero(np.frombuffer(line, np.uint8) == 32) if places or found else None
    starts = np.searchsorted(spaces, places).tolist() if places else []
    if found:
        first, last = ((np.searchsorted(spaces, [x[i] for x in found]) - 1).tolist() for i in (1, 2))
        spans = [(notices[i].label, f, n, e, 1.0 - e / len(notices[i].text)) for (i, _, _, e), f, n in zip(found, first, last)]
    else:
        spans = []
    labels = base | {s[0] for s in spans}
    score = 1.0 if base else max((s[4] for s in spans), default=0.0)
    rows = [{"label": n, "first_word": a, "last_word": b, "edits": e} for n, a, b, e, _ in spans]
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score, rows


def scan_licenses(docs: DataFrame, notices: tuple[Notice, ...] = NOTICES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """License phrases and notices of each whole text.

    Null texts count as empty: no words, no places, null first and last word,
    empty label lists, score 0. ``score`` is 1 with a base phrase, else one
    minus the edits per byte of the best notice. ``spans`` lists the fuzzy
    matches by place. Repeated rows are kept, other columns ignored, an empty
    table gives no rows. Work grows with a text's length and its number of
    places, not with their product; a worker holds one text's words at a time.
    """

    def run(batch: pa.RecordBatch) -> list:
        rows = [scan(t, notices) for t in batch.column(1).to_pylist()]
        return [batch.column(0), *([list(c) for c in zip(*rows)] if rows else [[]] * 8)]

    kind = dict(docs.dtypes)[id_col]
    return map_rows(
        docs.select(id_col, text_col),
        run,
        f"`{id_col}` {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,first_word:long,last_word:long,edits:int>>",
    )
