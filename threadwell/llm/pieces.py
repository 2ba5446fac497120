"""SentencePiece encoding and decoding: an Aho-Corasick automaton over the pieces drives a single-pass Viterbi."""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from threadwell.llm.common import text_batches

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Units kept with their encodings in one task.
MEMO = 200_000


class Pieces:
    """The vocabulary of a SentencePiece model and its segmentation of a text.

    For a model whose scores are log probabilities, the segmentation with the best sum of scores; a character outside
    of all chosen pieces becomes its UTF-8 byte pieces and costs 10 more than the worst piece, and ties go to the
    longest last piece. For a model of merges, whose scores are their order, sums mean nothing: a segmentation is the
    model's own if each piece and each two neighbours are what the merges make of their text, so the best path to a
    place is the one whose last two pieces agree.
    """

    def __init__(self, proto: bytes):
        model = sentencepiece.SentencePieceProcessor(model_proto=proto)
        self.pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        self.byte_ids = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        special = {i for i in range(len(self.pieces)) if model.is_control(i) or model.is_unknown(i) or model.is_byte(i)}
        self.scores = {i: model.get_score(i) for i in range(len(self.pieces)) if i not in special}
        self.fallback = min(self.scores.values()) - 10
        self.order = {self.pieces[i]: -s for i, s in self.scores.items()}
        self.by_merges = len(set(self.scores.values())) > 1 and all(float(s).is_integer() for s in self.scores.values())
        self.automaton = ahocorasick.Automaton()
        for i, s in self.scores.items():
            self.automaton.add_word(self.pieces[i], (len(self.pieces[i]), s, i))
        self.automaton.make_automaton()
        as_bytes = {b: i for i, b in enumerate(self.byte_ids)}
        self.bytes_of = [bytes([as_bytes[i]]) if i in as_bytes else b"" if i in special else self.pieces[i].replace(MARK, " ").encode() for i in range(len(self.pieces))]
        # No piece crosses into a word mark or over a character that no piece has: there a text falls into units.
        alone = "".join(re.escape(c) for c in "\n\t" if not any(c in self.pieces[i] for i in self.scores))
        if any(MARK in self.pieces[i].lstrip(MARK) for i in self.scores):
            self.unit = re.compile(r"(?s).+")
        elif alone:
            self.unit = re.compile(f"[{alone}]|{MARK}+[^{MARK}{alone}]*|[^{MARK}{alone}]+")
        else:
            self.unit = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
        self.memo: dict[str, bytes] = {}
        self.edges: dict[int, tuple | None] = {}
        self.known: dict[int, bool] = {}

    def edge(self, i: int) -> tuple | None:
        """How the merges make piece i: the symbols that stand first and last in turn, each with the merge that takes it
        (none for the piece itself). None if they do not make it."""
        if i not in self.edges:
            parts, order = list(self.pieces[i]), self.order
            left, right = [], []
            while len(parts) > 1:
                found = [(order[x + y], k) for k, (x, y) in enumerate(zip(parts, parts[1:], strict=False)) if x + y in order]
                if not found:
                    break
                when, k = min(found)  # the earliest merge, and of its places the first
                if k == 0:
                    left.append((parts[0], when))
                if k == len(parts) - 2:
                    right.append((parts[-1], when))
                parts[k : k + 2] = [parts[k] + parts[k + 1]]
            whole = [(self.pieces[i], math.inf)]
            self.edges[i] = (left + whole, right + whole) if len(parts) == 1 else None
        return self.edges[i]

    def agree(self, a: int, b: int) -> bool:
        """Whether the merges leave piece a followed by piece b as they are; a is -1 at the start and after bytes.

        They do unless, while a symbol x ends a and a symbol y begins b, the merge of x and y comes before the ones
        that take x and y. Of equal merges the first place goes first: in a, between, in b.
        """
        second = self.edge(b)
        if a < 0 or second is None:
            return second is not None
        (_, right), (left, _), i, j = self.edge(a), second, 0, 0
        while True:
            (x, x_ends), (y, y_ends) = right[i], left[j]
            when = self.order.get(x + y)
            if when is not None and when < x_ends and when <= y_ends:
                return False
            if x_ends == y_ends == math.inf:
                return True
            if x_ends <= y_ends:
                i += 1
            else:
                j += 1

    def by_neighbours(self, unit: str) -> list[int]:
        """Ids by a model of merges: the same pass, in which a path to a place is as good as its last two pieces agree."""
        n, known = len(unit), self.known
        last, come = [-1] * (n + 1), [-1] * (n + 1)
        for end, (length, _, i) in self.automaton.iter(unit):
            if come[end + 1] >= 0:
                continue
            start = end + 1 - length
            pair = (last[start] + 1) << 20 | i
            good = known.get(pair)
            if good is None:
                if len(known) >= 4 * MEMO:
                    known.clear()
                good = known[pair] = self.agree(last[start], i)
            if good:
                last[end + 1], come[end + 1] = i, start
        out: list[int] = []
        while n:
            if come[n] >= 0:
                out.append(last[n])
                n = come[n]
            else:
                n -= 1
                out.extend(self.byte_ids[b] for b in reversed(unit[n].encode("utf-8", "replace")))
        return out[::-1]

    def viterbi(self, unit: str) -> list[int]:
        """Ids of the best segmentation: one pass over the automaton's matches, which come by their last character."""
        n = len(unit)
        best = [0.0] * (n + 1)
        back: list[tuple[int, int]] = [(0, -1)] * (n + 1)
        at, fallback = 0, self.fallback

        def close(upto: int) -> None:
            nonlocal at
            while at < upto:
                at += 1
                best[at], back[at] = best[at - 1] + fallback, (at - 1, -1)

        for end, (length, score, i) in self.automaton.iter(unit):
            if end >= at:
                close(end + 1)
            start = end + 1 - length
            value = best[start] + score
            if value > best[end + 1] or (value == best[end + 1] and start < back[end + 1][0]):
                best[end + 1], back[end + 1] = value, (start, i)
        close(n)
        out: list[int] = []
        while n:
            start, i = back[n]
            out.extend([i] if i >= 0 else [self.byte_ids[b] for b in reversed(unit[start].encode("utf-8", "replace"))])
            n = start
        return out[::-1]

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text; none for an empty one."""
        if not text:
            return np.zeros(0, np.int32)
        memo, parts, segment = self.memo, [], self.by_neighbours if self.by_merges else self.viterbi
        for unit in self.unit.findall(MARK + text.replace(" ", MARK)):
            ids = memo.get(unit)
            if ids is None:
                ids = np.array(segment(unit), np.int32).tobytes()
                if len(unit) <= 64:
                    if len(memo) >= MEMO:
                        memo.clear()
                    memo[unit] = ids
            parts.append(ids)
        return np.frombuffer(b"".join(parts), np.int32)

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 bytes of the text that the ids stand for."""
        table = self.bytes_of
        out = b"".join([table[i] for i in ids.tolist()])
        return out[1:] if out[:1] == b" " else out


_loaded: dict[int, Pieces] = {}


def _pieces(proto: bytes) -> Pieces:
    """One automaton for each Python worker."""
    key = zlib.crc32(proto)
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Pieces(proto)
    return _loaded[key]


def encode(docs: DataFrame, model: str = MODEL, with_ids: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_tokens, ids_crc32, round_trip and (with_ids) token_ids of every document.

    ids_crc32 is the CRC-32 of the ids as little-endian 32-bit integers. round_trip says that decoding the ids gives
    the text again, with the word mark U+2581 read as a space, which is the one thing the encoding cannot keep. Null
    texts count as empty: no tokens, round_trip true. Rows are kept as they are, repeated ones too; other columns go.
    No shuffle; memory is bounded by one batch of texts and the memo. The model's file is read by the driver.
    """
    text_batches(docs.sparkSession)
    with open(model, "rb") as f:
        proto = f.read()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _pieces(proto)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                rows = []
                for text in part.column(1):
                    value = text.as_py() or ""
                    ids = coder.encode(value)
                    raw = value.encode("utf-8", "replace")
                    rows.append((len(raw), ids, zlib.crc32(ids.tobytes()), coder.decode(ids) == raw.replace(MARK.encode(), b" ")))
                columns = [part.column(0), pa.array([r[0] for r in rows], pa.int64()), pa.array([len(r[1]) for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64()), pa.array([r[3] for r in rows], pa.bool_())]
                if with_ids:
                    flat = np.concatenate([r[1] for r in rows]) if rows else np.zeros(0, np.int32)
                    ends = np.concatenate([[0], np.cumsum([len(r[1]) for r in rows])]).astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = "doc_id long, n_bytes long, n_tokens long, ids_crc32 long, round_trip boolean" + (", token_ids array<int>" if with_ids else "")
    names = [x.split(" ")[0] for x in schema.split(", ")]
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def decode(tokens: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id and text of rows with doc_id and token_ids (null ids: empty text)."""
    with open(model, "rb") as f:
        proto = f.read()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _pieces(proto)
        for batch in batches:
            texts = [coder.decode(np.array(x.as_py() or [], np.int32)).decode("utf-8", "replace") for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return tokens.select("doc_id", "token_ids").mapInArrow(run, "doc_id long, text string")
