"""Byte-level BPE as a lazily determinised transducer, and streaming decoding by a UTF-8 state machine.

Compiling. ``ranks`` gives every token's bytes and rank. In order of rank each token gets the two parts it is
merged from. Two neighbouring tokens are *compatible* when no merge across their border happens while they are
built; a sequence of tokens is the BPE result exactly if all neighbours are compatible. So the last token of
the result is unique for every prefix of the input.

Transducer. A state is the set of open hypotheses: for each earlier position from which some token may still
start, the node of the vocabulary's trie that has been read since, the last token before that position and the tokens
that are not yet output. Reading a byte extends the nodes, closes the one compatible token that ends here, and outputs
what all hypotheses agree on; as no node is deeper than the longest token, that is the bound of the lookahead.
States and transitions are made when first met and kept in a bounded table.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import re
import struct
from collections.abc import Callable, Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import text_of

#: Entries of a memo before it is set aside and then dropped; bounds a worker's memory.
MEMO = 400_000
STATES = 200_000
#: By how many ids they pack.
_PACK = [struct.Struct(f"<{n}I").pack for n in range(24)]


class Transducer:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {i: t for t, i in ranks.items()}
        self.pairs: dict[tuple[int, int], int] = {}
        #: token -> [(part, the token that swallows it)] along its left or right border, itself first.
        self.left: dict[int, list[tuple[int, float]]] = {}
        self.right: dict[int, list[tuple[int, float]]] = {}
        self.order = {i: -1 if len(t) == 1 else i for t, i in ranks.items()}
        self._compile()
        #: The trie: node * 256 + byte -> node, and the token that ends at a node.
        self._goto: dict[int, int] = {}
        self._token_at: list[int | None] = [None]
        for token, i in ranks.items():
            if i in self.left:
                node = 0
                for b in token:
                    edge, node = node << 8 | b, self._goto.get(node << 8 | b, len(self._token_at))
                    if node == len(self._token_at):
                        self._token_at.append(None)
                        self._goto[edge] = node
                self._token_at[node] = i
        self._memo: dict[tuple[int, int], bool] = {}
        self.reset()

    def _compile(self) -> None:
        never = float("inf")
        for token, i in sorted(self.ranks.items(), key=lambda x: (len(x[0]) > 1, x[1])):
            if len(token) == 1:
                self.left[i] = self.right[i] = [(i, never)]
                continue
            for cut in range(1, len(token)):
                a, b = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if a in self.left and b in self.left and max(self.order[a], self.order[b]) < i and not self._crossed(a, b):
                    self.pairs[a, b] = i
                    self.left[i] = [(i, never), (a, i), *self.left[a][1:]]
                    self.right[i] = [(i, never), (b, i), *self.right[b][1:]]
                    break

    def _crossed(self, a: int, b: int) -> bool:
        """Whether a merge across the border comes before both sides are complete. At equal ranks the left one is first."""
        for x, x_until in self.right[a]:
            for y, y_until in self.left[b]:
                made = self.pairs.get((x, y))
                if made is not None and made < x_until and made <= y_until:
                    return True
        return False

    def compatible(self, a: int, b: int) -> bool:
        known = self._memo.get((a, b))
        if known is None:
            if len(self._memo) > 2 * MEMO:
                self._memo.clear()
            known = self._memo[a, b] = not self._crossed(a, b)
        return known

    def reset(self) -> None:
        #: A state's number by its hypotheses (node, last token, tokens to output), earliest position first, and back.
        self._states: dict[tuple, int] = {}
        self._hyps: list[tuple] = []
        #: state * 256 + byte -> the state after it and the tokens that are certain now.
        self._moves: dict[int, tuple[int, tuple]] = {}
        self.start = self._state(((0, None, ()),))

    def _state(self, hyps: tuple) -> int:
        state = self._states.setdefault(hyps, len(self._hyps))
        if state == len(self._hyps):
            self._hyps.append(hyps)
        return state

    def _step(self, state: int, byte: int) -> tuple[int, tuple]:
        grown, token = [], None
        goto, token_at = self._goto, self._token_at
        for node, last, tail in self._hyps[state]:
            child = goto.get(node << 8 | byte)
            if child is not None:
                grown.append((child, last, tail))
                if token is None and (ends := token_at[child]) is not None and (last is None or self.compatible(last, ends)):
                    token, closed = ends, (*tail, ends)
        grown.append((0, token, closed))
        sure: tuple = ()
        if grown[0][2]:  # else the earliest hypothesis has nothing yet to agree on
            least, most = min(h[2] for h in grown), max(h[2] for h in grown)
            agreed = 0
            while agreed < len(least) and least[agreed] == most[agreed]:
                agreed += 1
            if agreed:
                sure, grown = least[:agreed], [(node, last, tail[agreed:]) for node, last, tail in grown]
        move = self._moves[state << 8 | byte] = (self._state(tuple(grown)), sure)
        return move

    def stream(self, data: Iterable[int]) -> Iterator[int]:
        """Token ids of one pre-token, each as soon as no later byte can change it."""
        state = self.start
        for byte in data:
            state, out = self._moves.get(state << 8 | byte) or self._step(state, byte)
            yield from out
        yield from self._hyps[state][-1][2]

    def encode(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        if len(self._hyps) > STATES:
            self.reset()
        ids, state, moves = [], self.start, self._moves.get
        for byte in piece:
            state, out = moves(state << 8 | byte) or self._step(state, byte)
            if out:
                ids += out
        ids += self._hyps[state][-1][2]
        return ids


class Utf8Machine:
    """Incremental UTF-8: a state machine that takes bytes and gives characters as they are complete.

    A state is how many continuation bytes must follow, the range of the next, the bits so far and how many bytes were read. Bytes that fit no sequence
    become U+FFFD, one for each longest start of a sequence, as Unicode recommends; ``bad`` counts them.
    """

    IDLE = (0, 0, 0, 0)

    def __init__(self):
        self.state, self.bad = self.IDLE, 0

    @staticmethod
    def step(state: tuple[int, int, int, int], byte: int) -> tuple[tuple[int, int, int, int], str, int]:
        """The next state, the characters that are certain now, and how many of them stand for bad bytes."""
        need, low, high, bits = state
        wrong = ""
        if need:
            if low <= byte <= high:
                bits = bits << 6 | byte & 0x3F
                return ((need - 1, 0x80, 0xBF, bits), "", 0) if need > 1 else (Utf8Machine.IDLE, chr(bits), 0)
            wrong = "\ufffd"  # the sequence ends here, and this byte begins anew
        if byte < 0x80:
            return Utf8Machine.IDLE, wrong + chr(byte), len(wrong)
        if 0xC2 <= byte <= 0xDF:
            return (1, 0x80, 0xBF, byte & 0x1F), wrong, len(wrong)
        if 0xE0 <= byte <= 0xEF:
            return (2, 0xA0 if byte == 0xE0 else 0x80, 0x9F if byte == 0xED else 0xBF, byte & 0x0F), wrong, len(wrong)
        if 0xF0 <= byte <= 0xF4:
            return (3, 0x90 if byte == 0xF0 else 0x80, 0x8F if byte == 0xF4 else 0xBF, byte & 0x07), wrong, len(wrong)
        return Utf8Machine.IDLE, wrong + "\ufffd", len(wrong) + 1

    def feed(self, data: bytes, final: bool = False) -> str:
        out = []
        for byte in data:
            self.state, made, bad = self.step(self.state, byte)
            self.bad += bad
            if made:
                out.append(made)
        if final and self.state[0]:
            self.state = self.IDLE
            self.bad += 1
            out.append("\ufffd")
        return "".join(out)


class SpaceMemo:
    """Ids of whole texts from a memo of their space-separated chunks.

    Each chunk is taken with the space before it. A pre-token never runs over that border unless white space stands on
    both sides of the space; such texts, and what ``odd`` finds, go to ``whole`` instead. ``each`` maps a list of chunks to
    their packed ids (little-endian unsigned 32-bit).
    """

    def __init__(self, each: Callable[[list[str]], list[bytes]], whole: Callable[[str], bytes], odd: str = ""):
        self.each, self.whole = each, whole
        self.odd = re.compile(r"\s (?:\s|\Z)" + odd)
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def __call__(self, text: str) -> bytes:
        if self.odd.search(text):
            return self.whole(text)
        first, *rest = text.split(" ")
        found = list(map(self.memo.get, rest))
        if None in found:
            missed = {w: self.older.get(w) for w, x in zip(rest, found, strict=True) if x is None}
            new = [w for w, x in missed.items() if x is None]
            missed.update(zip(new, self.each([" " + w for w in new]), strict=True))
            found = [missed[w] if x is None else x for w, x in zip(rest, found, strict=True)]
            if len(self.memo) > MEMO:
                self.memo, self.older = {}, self.memo
            self.memo.update((w, x) for w, x in missed.items() if len(w) < 64)
        return b"".join([self.each([first])[0] if first else b"", *found])


class Codec:
    """Encodes and decodes by a rank file, as tiktoken would without special tokens."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.machine = Transducer(ranks)
        self.split = regex.compile(pattern).findall
        self._pieces: dict[str, bytes] = {}
        self.packed = SpaceMemo(lambda chunks: [self._run(c) for c in chunks], self._run)
        #: What the machine makes of a token's bytes from its idle state, for tokens that leave it idle and have no bad byte.
        self._whole: dict[int, str] = {}
        for i, token in self.machine.bytes_of.items():
            m = Utf8Machine()
            text = m.feed(token)
            if m.state == m.IDLE and not m.bad:
                self._whole[i] = text

    def _run(self, text: str) -> bytes:
        out = []
        for piece in self.split(text):
            ids = self._pieces.get(piece)
            if ids is None:
                if len(self._pieces) > MEMO:
                    self._pieces.clear()
                ids = self.machine.encode(piece.encode())
                ids = _PACK[len(ids)](*ids) if len(ids) < len(_PACK) else np.array(ids, "<u4").tobytes()
                if len(piece) < 64:
                    self._pieces[piece] = ids
            out.append(ids)
        return b"".join(out)

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(self.packed(text), "<u4")

    def decode(self, ids: np.ndarray, step: int = 1 << 16) -> Iterator[tuple[bytes, str, int]]:
        """The bytes of ``ids`` in parts, the characters that are complete with each, and how many stand for bad bytes. Unknown ids give nothing.

        From its idle state the machine's moves over whole tokens are known; only tokens that begin or end inside a character are fed byte by byte.
        """
        machine, whole, bytes_of = Utf8Machine(), self._whole.get, self.machine.bytes_of
        for i in range(0, max(len(ids), 1), step):
            part = ids[i : i + step].tolist()
            made = list(map(whole, part))
            before = machine.bad
            if machine.state != machine.IDLE or None in made:
                for k, token in enumerate(part):
                    if made[k] is None or machine.state != machine.IDLE:
                        made[k] = machine.feed(bytes_of.get(token, b""))
            if i + step >= len(ids):
                made.append(machine.feed(b"", final=True))
            yield b"".join([bytes_of.get(token, b"") for token in part]), "".join(made), machine.bad - before


@cache
def codec(path: str, pattern: str) -> Codec:
    """One codec a worker process. Its tables are many small objects; looking for garbage among them often is slow."""
    gc.set_threshold(200_000, 20, 50)
    return Codec(path, pattern)


def encode(documents: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids): ids is binary, little-endian unsigned 32-bit. Null text counts as empty: no ids."""

    def run(batches):
        c = codec(path, pattern)
        for b in batches:
            ids = [c.packed(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())],
                ["doc_id", "n_tokens", "ids"],
            )

    return documents.select("doc_id", text_of(documents).alias("text")).mapInArrow(
        run, f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids binary"
    )


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, text) of ``encode``'s rows; null ids give an empty text."""

    def run(batches):
        c = codec(path, pattern)
        for b in batches:
            texts = ["".join([text for _, text, _ in c.decode(np.frombuffer(x or b"", "<u4"))]) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(
        run, f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, text string"
    )


def round_trip(documents: DataFrame, path: str, pattern: str) -> DataFrame:
    """Per document the digests of its ids and of the bytes decoded from them: doc_id, n_tokens, ids_sha256, decoded_sha256, and decoded_chars, the
    characters that the UTF-8 machine made of those bytes, and bad_chars, those that stand for bad bytes.

    Encodes and decodes in the same task, so ids never leave it. Null text counts as empty. Rows may repeat or lack an id;
    other columns are not looked at. An empty table gives an empty result.
    """
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "decoded_chars", "bad_chars"]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]

    def told(c: Codec, text: str) -> tuple:
        ids = c.packed(text)
        decoded, chars, wrong = hashlib.sha256(), 0, 0
        for data, part, bad in c.decode(np.frombuffer(ids, "<u4")):
            decoded.update(data)
            chars += len(part)
            wrong += bad
        return len(ids) // 4, hashlib.sha256(ids).hexdigest(), decoded.hexdigest(), chars, wrong

    def run(batches):
        c = codec(path, pattern)
        for b in batches:
            rows = [told(c, text) for text in b.column(1).to_pylist()]
            cols = zip(*rows, strict=True) if rows else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, k) for x, k in zip(cols, kinds, strict=True))], names)

    kind = documents.schema["doc_id"].dataType.simpleString()
    fields = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, decoded_chars long, bad_chars long"
    return documents.select("doc_id", text_of(documents).alias("text")).mapInArrow(run, fields)
