"""Secret scans by one combined deterministic automaton.

All rules are compiled together (subset construction, minimisation) into one transition array that reads every byte
of a text once and tells which rules end where. A rule that fired is then resolved on that text by its own anchored
automaton: leftmost, longest, non-overlapping spans, of which those too short for the rule are dropped.

The first three rules are the fixed base; the others are the spans this method adds.

Defined cases: a null or empty text has no spans; a null id stays null; repeated rows give a row each; an empty table
gives an empty result; only the id and text columns are read, so further columns never clash.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from . import automaton as A
from .common import batches, id_text


@dataclass(frozen=True)
class Rule:
    """``pattern`` gives the spans; a span is kept if ``valid`` matches all of it.

    ``sign`` is what the combined automaton looks for: it ends inside every kept span, and is written without long
    counts where it can be, as counts of several rules multiply the states. ``fold``: a first part in either case.
    """

    kind: str
    pattern: str
    valid: str
    sign: str
    fold: str = ""


# The base rules of the contract (the key words in either case), then the added ones.
_ASSIGN_KEY = "(password|passwd|secret|token|api_?key)"
_ASSIGN_SEP = "[\"']?\\x20*[:=]\\x20*[\"']?"
RULES = (
    Rule("assign", _ASSIGN_SEP + "[A-Za-z0-9+/_.=-]+", _ASSIGN_SEP + "[A-Za-z0-9+/_.=-]{6,}", _ASSIGN_SEP + "[A-Za-z0-9+/_.=-]", _ASSIGN_KEY),
    Rule("access", "AKIA[A-Z0-9]+", "AKIA[A-Z0-9]{16,}", "AKIA[A-Z0-9]"),
    Rule("hex", "[0-9a-f]+", "[0-9a-f]{24,}", "[0-9a-f]{24}"),
    Rule("private_key", "-----BEGIN [A-Z ]*PRIVATE KEY-----", "-----BEGIN [A-Z ]*PRIVATE KEY-----", "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", "gh[pousr]_[A-Za-z0-9]+", "gh[pousr]_[A-Za-z0-9]{36,}", "gh[pousr]_[A-Za-z0-9]"),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]+", "xox[abprs]-[A-Za-z0-9-]{10,}", "xox[abprs]-[A-Za-z0-9-]"),
    Rule("jwt", "eyJ[A-Za-z0-9_-]+\\.eyJ[A-Za-z0-9_-]+\\.[A-Za-z0-9_-]+", "eyJ[A-Za-z0-9_-]+\\.eyJ[A-Za-z0-9_-]+\\.[A-Za-z0-9_-]+", "\\.eyJ[A-Za-z0-9_-]"),
)
BASE = ("assign", "access", "hex")


class _Hit:
    """Stands where an accepting row would: indexing it fails, which ends the tight loop."""

    __slots__ = ("rules", "row")


def _tree(rule: Rule, pattern: str):
    rest = A.parse(pattern)
    return ("cat", [A.either_case(A.parse(rule.fold)), rest]) if rule.fold else rest


class Scanner:
    """The compiled rules. Rows of the transition arrays are lists that hold the next row, so a step is one lookup."""

    def __init__(self, rules: tuple[Rule, ...] = RULES) -> None:
        self.rules = rules
        dfa = A.compile_rules([_tree(r, r.sign) for r in rules], anchored=False)
        rows = [[None] * 256 for _ in dfa.table]
        hits: list[object] = []
        for k, row in enumerate(rows):
            h: object = row
            if dfa.accepts[k]:
                h = _Hit()
                h.rules, h.row = int(dfa.accepts[k]), row
            hits.append(h)
        for row, to in zip(rows, dfa.table.tolist()):
            row[:] = [hits[t] for t in to]
        self.start = rows[0]
        self.spans_of = [_Anchored(_tree(r, r.pattern)) for r in rules]
        self.valid = [_Anchored(_tree(r, r.valid)) for r in rules]

    def fired(self, data: bytes) -> int:
        """Bits of the rules with an end anywhere: one pass over the bytes."""
        found, row, it = 0, self.start, iter(data)
        every = (1 << len(self.rules)) - 1
        while True:
            try:
                for b in it:
                    row = row[b]
            except TypeError:  # the byte before b led into a hit; b is still to be read
                found |= row.rules
                if found == every:
                    return found
                row = row.row[b]
                continue
            return found | row.rules if isinstance(row, _Hit) else found

    def spans(self, data: bytes) -> list[tuple[int, int, int]]:
        """``(start, rule, end)`` in code points, by start, then rule."""
        found = self.fired(data)
        if not found:
            return []
        out = [(a, k, b) for k in range(len(self.rules)) if found >> k & 1
               for a, b in self.spans_of[k].leftmost(data) if self.valid[k].longest(data, a) == b]
        if not data.isascii():
            at, chars, pos = {}, 0, 0
            for p in sorted({x for a, _, b in out for x in (a, b)}):
                chars += len(data[pos:p].decode("utf-8", "replace"))
                at[p], pos = chars, p
            out = [(at[a], k, at[b]) for a, k, b in out]
        return sorted(out)


class _Anchored:
    """Leftmost-longest matches of one rule by its own automaton.

    A start that comes to nothing costs the bytes read from it. Once these add up to the length of the text, one pass from
    its end by the reversed automaton marks the places where a match does start, and only those are tried: the work stays
    linear in the text whatever it holds.
    """

    def __init__(self, tree) -> None:
        dfa = A.compile_rules([tree], anchored=True)
        n = len(dfa.table)
        dead = next((s for s in range(n) if not dfa.accepts[s] and (dfa.table[s] == s).all()), n)
        self.rows = [row + [bool(a)] for row, a in zip(dfa.table.tolist(), dfa.accepts)]
        self.dead = dead
        self.first = bytes(int(t != dead) for t in dfa.table[0].tolist())
        self.tree = tree

    @functools.cached_property
    def _from_end(self) -> tuple[list, list]:
        dfa = A.compile_rules([A.backwards(self.tree)], anchored=False)
        return dfa.table.tolist(), [bool(a) for a in dfa.accepts]

    def starts(self, data: bytes) -> bytes:
        """1 where a match starts."""
        rows, accepts = self._from_end
        out, s = bytearray(len(data)), 0
        for i in range(len(data) - 1, -1, -1):
            s = rows[s][data[i]]
            if accepts[s]:
                out[i] = 1
        return bytes(out)

    def _longest(self, data: bytes, pos: int) -> tuple[int, int]:
        """End of the longest match that starts at ``pos``, or -1, and where reading stopped."""
        rows, dead, s, end, i = self.rows, self.dead, 0, -1, pos
        for i in range(pos, len(data)):
            s = rows[s][data[i]]
            if s == dead:
                break
            if rows[s][256]:
                end = i + 1
        return end, i

    def longest(self, data: bytes, pos: int) -> int:
        return self._longest(data, pos)[0]

    def leftmost(self, data: bytes) -> Iterator[tuple[int, int]]:
        can_start, lost, marked = data.translate(self.first), 0, False
        pos = can_start.find(1)
        while pos >= 0:
            end, stop = self._longest(data, pos)
            if end > pos:
                yield pos, end
            else:
                lost += stop - pos
                if lost > len(data) and not marked:
                    can_start, marked = self.starts(data), True
            pos = can_start.find(1, max(end, pos + 1))


@functools.lru_cache(maxsize=4)
def scanner(rules: tuple[Rule, ...] = RULES) -> Scanner:
    return Scanner(rules)


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``(doc_id, found array<struct<kind, start, end>>)`` of every row; offsets are code points, end exclusive."""
    kinds = [r.kind for r in rules]
    kind_type = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def work(it):
        s = scanner(rules)
        for b, texts in batches(it):
            found = [[{"kind": kinds[k], "start": a, "end": e} for a, k, e in s.spans(t)] for t in texts]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(found, pa.list_(kind_type))], ["doc_id", "found"])

    return id_text(df, id_col, text_col).mapInArrow(
        work, "doc_id long, found array<struct<kind: string, start: long, end: long>>")


def redacted(text: str, s: Scanner) -> str:
    """The text with a marker of its first kind in place of each run of overlapping spans."""
    out, at, end = [], 0, -1
    for a, k, b in s.spans(text.encode("utf-8", "replace")):
        if a >= end:
            out += [text[at:a], f"[{s.rules[k].kind}]"]
        end = at = max(end, b)
    return "".join(out) + text[at:] if out else text


def redact(docs: DataFrame, text_col: str = "text", chars_col: str = "n_chars", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """All rows of ``docs`` with their columns, secrets replaced in ``text_col``; ``chars_col`` follows if it is there."""
    def work(it):
        s = scanner(rules)
        for b in it:
            texts = b.column(text_col).to_pylist()
            new = [None if t is None else redacted(t, s) for t in texts]
            i = b.schema.get_field_index(text_col)
            b = b.set_column(i, b.schema.field(i), pa.array(new, b.schema.field(i).type))
            j = b.schema.get_field_index(chars_col)
            if j >= 0:
                old = b.column(j).to_pylist()
                n = [c if t == u else len(u) for c, t, u in zip(old, texts, new)]
                b = b.set_column(j, b.schema.field(j), pa.array(n, b.schema.field(j).type))
            yield b

    return docs.mapInArrow(work, docs.schema)
