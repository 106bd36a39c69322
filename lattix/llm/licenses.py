"""License scans: Aho-Corasick over identifier tags and notice phrases, and licence expressions by a shunting-yard parser.

Texts are lower-cased (A-Z) and cut into words; a phrase is found where its words stand consecutively. An identifier tag
(``SPDX-License-Identifier: <expression>``) is found by the same automaton; its expression is then read from the text itself.

Notices are read as expressions too: phrases with nothing but "or", "and" and filling words between them are alternatives or terms of one
bracket ("the MIT license or the Apache License, Version 2.0"), all others stand apart and hold together. ``permitted`` tells whether
the identifier tags, or without any the notices, can be met by accepted licences alone; it is null where a text holds neither.
A phrase within a longer one names no licence of its own there.

One map-only pass: no shuffle. Null and empty texts have no words and no labels; an expression that cannot be parsed gives none. Time
grows in proportion to a text's length. Phrases that overlap or stand often count at each place; equal labels are named once. Repeated
rows each get theirs; an empty table gives no rows. Only the id and text columns are read, so that other columns may have any name.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import LOWER, NOT_ALNUM, text_buffers

#: Fixed values of the contract: phrase and label.
BASE_PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: The method's own notice phrases.
NOTICES = {
    "bsd license": "bsd",
    "boost software license": "bsl-1.0",
    "creative commons": "cc",
    "eclipse public license": "epl",
    "gnu affero general public license": "agpl",
    "gnu lesser general public license": "lgpl",
    "isc license": "isc",
    "mozilla public license": "mpl",
    "public domain": "public-domain",
    "released into the public domain": "public-domain",
    "all rights reserved": "proprietary",
}
TAG = "spdx license identifier"
#: Licences a corpus may hold, for the evaluated expressions.
ACCEPTED = frozenset(["0bsd", "apache-2.0", "bsd-2-clause", "bsd-3-clause", "bsl-1.0", "cc-by-4.0", "cc0-1.0", "isc", "mit", "unlicense", "zlib"])
#: Of the labels that phrases give, those accepted, and the words that may stand between terms. "cc by" leaves open which of its kinds is meant.
ACCEPTED_NOTICES = frozenset(["apache", "bsd", "mit", "public-domain"])
FILLING = frozenset("a at either licence license of option the under version your".split())
_EXPRESSION = re.compile(r"SPDX-License-Identifier[^A-Za-z0-9(]{1,8}([A-Za-z0-9.+:() \t-]+)", re.I)
_PART = re.compile(r"[()]|[A-Za-z0-9.+:-]+")
_BINDS = {"or": 1, "and": 2, "with": 3}
_TO_SPACE = bytes(32 if LOWER[b] in NOT_ALNUM else LOWER[b] for b in range(256))
SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, permitted boolean"


def postfix(expression: str) -> list[str] | None:
    """Shunting-yard: operands and operators in evaluation order. Prose after the last complete operand is left out; None if nothing parses."""
    out: list[str] = []
    held: list[str] = []
    operand = True
    for part in _PART.findall(expression):
        low = part.lower().rstrip(".")
        if part == "(" and operand:
            held.append(part)
        elif part == ")" and not operand and "(" in held:
            while held[-1] != "(":
                out.append(held.pop())
            held.pop()
        elif low in _BINDS and not operand:
            while held and held[-1] != "(" and _BINDS[held[-1]] >= _BINDS[low]:
                out.append(held.pop())
            held.append(low)
            operand = True
        elif operand and low and part not in "()" and low not in _BINDS:
            out.append(low)
            operand = False
        else:
            break
    if operand:
        return None
    if "(" in held:
        return None
    return out + held[::-1]


def evaluate(parts: list[str], accepted: frozenset[str] = ACCEPTED) -> tuple[set[str], bool]:
    """The licences an expression names, and whether it can be met by accepted licences alone: or takes either, and both."""
    stack: list[tuple[set[str], bool]] = []
    for p in parts:
        if p in _BINDS:
            (right, r), (left, l) = stack.pop(), stack.pop()
            stack.append((left, l) if p == "with" else (left | right, (l or r) if p == "or" else (l and r)))
        else:
            stack.append(({p}, p in accepted))
    return stack[0]


def notice_expression(spans: list[tuple[int, int, str]], parts: list[bytes]) -> str:
    """The expression of notices that cover words start..stop-1 of ``parts``: brackets of terms, joined by "and"."""
    groups: list[str] = []
    stop = 0
    for start, end, label in sorted(spans, key=lambda x: (x[0], -x[1])):
        if start < stop:
            continue
        between = [w for w in parts[stop:start] if w.decode('latin-1') not in FILLING and not w.isdigit()] if groups else []
        if between in ([b"or"], [b"and"]):
            groups[-1] += f" {between[0].decode()} {label}"
        else:
            groups.append(label)
        stop = end
    return " and ".join(f"({g})" for g in groups)


@lru_cache(maxsize=4)
def automaton(phrases: tuple[str, ...]):
    import ahocorasick

    built = ahocorasick.Automaton()
    for p in phrases:
        built.add_word(f" {p} ", p)
    built.make_automaton()
    return built


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", base: dict[str, str] = BASE_PHRASES, notices: dict[str, str] = NOTICES, accepted: Iterable[str] = ACCEPTED | ACCEPTED_NOTICES) -> DataFrame:
    """One row per document. n_base counts all places of base phrases; score is 1 for an identifier tag, 0.9 for a base phrase, 0.6 for another notice, 0 for none."""
    phrases, accepted = tuple([*base, *notices, TAG]), frozenset(accepted)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = automaton(phrases)
        for batch in batches:
            data, at = text_buffers(batch.column(1))
            view = memoryview(data)
            cols: list[list] = [[] for _ in range(8)]
            for k in range(len(batch)):
                raw = bytes(view[at[k] : at[k + 1]])
                parts = raw.translate(_TO_SPACE).split()
                line = b" " + b" ".join(parts) + b" "
                blanks = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
                places, spans, labels, own, tagged, permitted = [], [], set(), set(), False, None
                for end, phrase in found.iter(line.decode("latin-1")):
                    if phrase == TAG:
                        tagged = True
                        continue
                    spans.append((end - len(phrase), phrase))
                    if phrase in base:
                        places.append(end - len(phrase))
                        labels.add(base[phrase])
                    else:
                        own.add(notices[phrase])
                places = (np.searchsorted(blanks, places) - 1).tolist()  # words before each
                if tagged:
                    named = [e for x in _EXPRESSION.findall(raw.decode("utf-8", "replace")) if (e := postfix(x))]
                    for names, ok in map(lambda e: evaluate(e, accepted), named):
                        own |= names
                        permitted = ok if permitted is None else permitted and ok
                    tagged = bool(named)
                if permitted is None and spans:
                    word = lambda x: int(np.searchsorted(blanks, x)) - 1
                    named_by = [(word(x), word(x) + p.count(" ") + 1, base.get(p) or notices[p]) for x, p in spans]
                    _, permitted = evaluate(postfix(notice_expression(named_by, parts)), accepted)
                score = 1.0 if tagged else 0.9 if labels else 0.6 if own else 0.0
                row = (len(parts), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)), ",".join(sorted(labels | own)), score, permitted)
                for c, v in zip(cols, row, strict=True):
                    c.append(v)
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return docs.selectExpr(f"cast({id_col} as long) as doc_id", f"{text_col} as text").mapInArrow(scan, SCHEMA)
