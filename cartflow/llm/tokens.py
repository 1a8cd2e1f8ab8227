"""Token counts by prefix dynamic programming over a byte-level BPE vocabulary.

For every prefix of a text the exact token count is known, so questions of
length, truncation and budget are look-ups and nothing is encoded twice.

Within one pre-token the table is filled byte by byte: the encoding of a
prefix ends in one token ``t``, and the rest is the encoding of the shorter
prefix, so ``count[i] = count[i - len(t)] + 1``.  ``t`` is the one vocabulary
entry ending at ``i`` that stays apart from the last token before it when the
two are merged by rank.  Space-separated units repeat a lot, so a worker keeps
the tables of the units it has seen (bounded).

Null text counts as empty; an empty text has no tokens; a text of any length
takes time in proportion.  The special strings of the vocabulary inside a text
count one token each, as the library does by default.
"""

from __future__ import annotations

import json
from array import array
from bisect import bisect_right
from itertools import accumulate

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartflow.llm.common import map_batches, texts_of, worker_state

SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PIECES = regex.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
ANY_SPACE = regex.compile(rf"[{SPACE}\x1c-\x1f]")
RUNS = regex.compile(rf"[{SPACE}]+")
CONTRACTIONS = {"'re", "'ve", "'ll", "'s", "'t", "'m", "'d"}


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable ones for themselves, the rest from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class PrefixCounter:
    """Prefix counts for one ``tokenizers`` JSON file (byte-level BPE)."""

    def __init__(self, path: str, max_units: int = 800_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        as_bytes = lambda s: bytes(letters[c] for c in s)
        self.vocab = {as_bytes(s): i for s, i in spec["model"]["vocab"].items()}
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.rank = {(as_bytes(a), as_bytes(b)): r for r, (a, b) in enumerate(merges)}
        self.longest = max(map(len, self.vocab))
        specials = [t["content"] for t in spec["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, specials))) if specials else None
        self.marks = tuple(specials)
        self.split = {a + b: (a, b) for a, b in self.rank}
        self.spines: dict[tuple[bytes, int], list[tuple[bytes, int]]] = {}
        self.apart: dict[tuple[bytes, bytes], bool] = {}
        self.units: dict[str, bytes | array] = {}
        self.pieces: dict[str, bytes | array] = {}
        self.max_units = max_units

    def _spine(self, token: bytes, side: int) -> list[tuple[bytes, int]]:
        """The parts that stand at the right (side 1) or left (0) end of a token as it is merged, each with the rank of the merge that ends it."""
        key = (token, side)
        found = self.spines.get(key)
        if found is None:
            found, until, part = [], 1 << 30, token
            while True:
                found.append((part, until))
                if part not in self.split:
                    break
                until, part = self.rank[self.split[part]], self.split[part][side]
            self.spines[key] = found
        return found

    def _stay_apart(self, left: bytes, right: bytes) -> bool:
        """Whether no merge joins the two across their border.

        Merges go by rank, the leftmost first; a part is always made before
        it is merged on.  So the border gives way if some pair that meets
        there has a rank before its left part ends (a tie goes to the left
        token's own merge) and not after its right part ends.
        """
        if len(self.apart) > 1_000_000:
            self.apart.clear()
        rank, ok = self.rank, True
        for b, b_until in self._spine(right, 0):
            for a, a_until in self._spine(left, 1):
                r = rank.get((a, b))
                if r is not None and r < a_until and r <= b_until:
                    ok = False
        self.apart[(left, right)] = ok
        return ok

    def piece(self, data: bytes) -> list[int]:
        """Token counts of the prefixes of one pre-token, by bytes, from the empty one."""
        vocab, apart, longest = self.vocab, self.apart, self.longest
        count, last = [0], [b""]
        for end in range(1, len(data) + 1):
            start = end - longest if end > longest else 0
            while True:
                token = data[start:end]
                if token in vocab:
                    if not start:  # a vocabulary entry is the encoding of its own bytes
                        break
                    before = last[start]
                    ok = apart.get((before, token))
                    if ok or ok is None and self._stay_apart(before, token):
                        break
                start += 1
            count.append(count[start] + 1)
            last.append(token)
        return count

    def _piece_table(self, piece: str) -> bytes | array:
        """Counts after each code point of a pre-token; kept for short ones."""
        found = self.pieces.get(piece)
        if found is None:
            if piece.isascii():
                counts = self.piece(piece.encode())
                if len(piece) == 3 and piece in CONTRACTIONS:
                    counts[2] = 2  # cut short, the apostrophe and the letter are two pre-tokens
                del counts[0]
            else:
                by_byte = self.piece(piece.encode("utf-8", "surrogatepass"))
                counts = [by_byte[at] for at in accumulate([len(c.encode("utf-8", "surrogatepass")) for c in piece])]
            found = bytes(counts) if max(counts) < 256 else array("I", counts)
            if len(piece) < 64:
                if len(self.pieces) >= self.max_units:
                    self.pieces.clear()
                self.pieces[piece] = found
        return found

    def _ordinary(self, text: str) -> array:
        """Counts after each code point of a text without special strings."""
        out, total, starts = array("I"), 0, {0: 0}
        for piece in PIECES.findall(text):
            table = self._piece_table(piece)
            out.extend([total + c for c in table])
            total += table[-1]
            starts[len(out)] = total
        for m in RUNS.finditer(text):  # a prefix that ends in white space has the run so far as one pre-token
            if m.end() - m.start() > 1:
                base = starts[m.start()]
                out[m.start():m.end()] = array("I", [base + c for c in self._piece_table(m[0])])
        return out

    def _table(self, unit: str) -> bytes | array:
        """Counts after each code point of a space-separated unit."""
        pieces = PIECES.findall(unit)
        if len(pieces) == 1:
            return self._piece_table(unit)
        if ANY_SPACE.search(unit, 1):
            return self._ordinary(unit)
        counts: list[int] = []
        total = 0
        for piece in pieces:
            table = self._piece_table(piece)
            counts += [total + c for c in table] if total else table
            total += table[-1]
        return bytes(counts) if max(counts) < 256 else array("I", counts)

    def tables(self, text: str) -> list[bytes | array]:
        """Prefix counts of consecutive units of the text, each from its own start, together covering it."""
        if not text:
            return []
        units = text.split(" ")
        found = list(map(self.units.get, units))
        found[0] = self._table(units[0]) if units[0] and not (units[0][0].isspace() or units[0][-1].isspace()) else None
        if found[0] is None:
            return [self._ordinary(text)]
        for i, table in enumerate(found):
            if table is None:
                unit = units[i]
                if not unit or ANY_SPACE.match(unit) or ANY_SPACE.match(unit[-1]):
                    return [self._ordinary(text)]  # longer runs of white space: pre-tokens depend on what follows
                table = found[i] = self._table(" " + unit)
                if len(unit) < 64 and not ANY_SPACE.search(unit):
                    if len(self.units) >= self.max_units:
                        self.units.clear()
                    self.units[unit] = table
        return found

    def prefix_counts(self, text: str) -> array:
        """Token count of every prefix, by code points: item i is that of ``text[:i]``."""
        out, base, at = array("I", [0]), 0, 0
        for m in self.special.finditer(text) if self.special and any(s in text for s in self.marks) else ():
            shown = self._ordinary(text[at:m.end() - 1])
            out.extend([base + c for c in shown])
            base = out[m.start()] + 1
            out.append(base)
            at = m.end()
        for table in self.tables(text[at:]):
            out.extend([base + c for c in table])
            base = out[-1]
        return out

    def question(self, text: str, limit: int) -> tuple[int, int]:
        """The count of the whole text, and the code points of its longest prefix within ``limit`` tokens."""
        if any(s in text for s in self.marks):
            counts = self.prefix_counts(text)
            return counts[-1], next(i for i in range(len(counts) - 1, -1, -1) if counts[i] <= limit)
        tables = self.tables(text)
        ends = list(accumulate([t[-1] for t in tables]))
        if not ends or ends[-1] <= limit:
            return (ends[-1] if ends else 0), len(text)
        # a count may fall as a longer token closes, so the cut may lie one unit after the first excess
        k = bisect_right(ends, limit)
        if k and ends[k - 1] > limit:
            k -= 1
        base, at = (ends[k - 1] if k else 0), sum(map(len, tables[:k]))
        inside = [i + 1 for i, c in enumerate(tables[k]) if base + c <= limit]
        return ends[-1], at + (inside[-1] if inside else 0)


def counter(path: str) -> PrefixCounter:
    return worker_state(f"prefix:{path}", lambda: PrefixCounter(path))


def token_counts(docs: DataFrame, path: str, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, UTF-8 bytes, tokens, whether over ``limit``, and ``fit_chars``, the code points of the longest prefix within it.

    One pass without a shuffle; repeated rows give repeated rows.
    """
    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        count = counter(path)
        texts = texts_of(batch)
        found = [count.question(t, limit) for t in texts]
        n = pa.array([x[0] for x in found], pa.int64())
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array([len(t.encode("utf-8", "surrogatepass")) for t in texts], pa.int64()), n,
             pa.array([x[0] > limit for x in found], pa.bool_()), pa.array([x[1] for x in found], pa.int64())],
            ["doc_id", "n_bytes", "n_tokens", "over_limit", "fit_chars"])
    kind = docs.schema[id_col].dataType.simpleString()
    return map_batches(docs, [F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")],
                       f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean, fit_chars long", make)


def prefix_tables(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id and ``counts``, the token count of every prefix of the text by code points (item 0: the empty one)."""
    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        count = counter(path)
        rows = [count.prefix_counts(t) for t in texts_of(batch)]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([list(r) for r in rows], pa.list_(pa.int32()))],
                                          ["doc_id", "counts"])
    kind = docs.schema[id_col].dataType.simpleString()
    return map_batches(docs, [F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")],
                       f"doc_id {kind}, counts array<int>", make)
