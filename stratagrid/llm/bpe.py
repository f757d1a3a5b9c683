"""Operator 1: byte-level BPE encoding and decoding.

The vocabulary's byte strings, mapped to Latin-1, form an Aho-Corasick automaton. A piece of text is covered from its
left end by longest matches. Each token must be compatible with the one before it: the merges of the two tokens'
concatenation must not cross the border between them. Where they would, the next shorter token that is a prefix takes
its place, and where none is left, the token before goes back. Positions found to lead nowhere are marked, so each is
left at most once and the work is linear in the piece's length. Compatibility depends on the pair alone and is memoised.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import clash, held, need

#: Splits text before the merges (fixed value of the public vocabularies).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Pieces, words with their punctuation, and a quarter of the pairs that each worker remembers, beside as many older pieces
#: and words. What is forgotten is computed anew.
MEMO = 200_000
#: Longer pieces are encoded anew each time.
MEMO_CHARS = 48
#: A vocabulary goes to every worker, so its size is checked.
MAX_VOCABULARY = 2_000_000


def read_ranks(path: str) -> dict[bytes, int]:
    """The rank file: a base64 byte string and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


class Codec:
    """Encodes and decodes by ``ranks`` (byte string to rank, which is the id)."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        import ahocorasick
        import regex

        if len(ranks) > MAX_VOCABULARY:
            raise ValueError(f"{len(ranks)} tokens; at most {MAX_VOCABULARY}")
        if missing := [b for b in range(256) if bytes([b]) not in ranks]:
            raise ValueError(f"a byte-level vocabulary has all 256 bytes; {len(missing)} are missing")
        self.split = regex.compile(pattern).findall
        self.ids = {k.decode("latin-1"): v for k, v in ranks.items()}
        self.bytes = {v: k for k, v in ranks.items()}
        self.size = {v: len(k) for k, v in ranks.items()}
        self.text = {v: str(v) for v in ranks.values()}
        self.reach = max(map(len, ranks))
        automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY)
        for k, v in self.ids.items():
            automaton.add_word(k, v)
        automaton.make_automaton()
        self.longest = automaton.iter_long
        self.compatible: dict[int, bool] = {}
        self.memo: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}
        self.words: dict[str, tuple[int, str, bytes]] = {}
        self.older_words: dict[str, tuple[int, str, bytes]] = {}
        #: The pair that each token is merged from (single bytes: the token twice), the token that each pair makes, and
        #: for each token the longest shorter token that it starts with.
        self.parts: dict[int, tuple[int, int]] = {}
        self.made: dict[tuple[int, int], int] = {}
        self.shorter: dict[int, int | None] = {}
        self._learn()

    def _learn(self) -> None:
        for token, i in self.ids.items():
            self.shorter[i] = next((self.ids[token[:n]] for n in range(len(token) - 1, 0, -1) if token[:n] in self.ids), None)
        for token, i in sorted(self.ids.items(), key=lambda x: x[1]):
            self.parts[i] = (i, i)
            left = self.shorter[i]
            while left is not None:
                right = self.ids.get(token[self.size[left]:])
                if right is not None and left < i and right < i and self.fits(left, right):
                    self.parts[i] = (left, right)
                    self.made[left, right] = i
                    break
                left = self.shorter[left]

    def fits(self, left: int, right: int) -> bool:
        """Whether no merge crosses the border when ``left`` is followed by ``right``.

        Both tokens are undone from their last merge on, later merges first; at each step the two tokens that touch the
        border must not make a token that the merges would have made before.
        """
        bound, parts, made = None, self.parts, self.made
        while True:
            both = made.get((left, right))
            if both is not None and (bound is None or both < bound):
                return False
            if left > right:
                inner = parts[left][1]
                if inner != left:
                    left, bound = inner, left
                    continue
                inner = parts[right][0]
                if inner == right:
                    return True
                right, bound = inner, right + 1
            else:
                inner = parts[right][0]
                if inner != right:
                    right, bound = inner, right + 1
                    continue
                inner = parts[left][1]
                if inner == left:
                    return True
                left, bound = inner, left

    def _fits(self, left: int, right: int) -> bool:
        key = left << 32 | right
        known = self.compatible.get(key)
        if known is None:
            if len(self.compatible) >= 4 * MEMO:
                self.compatible.clear()
            known = self.compatible[key] = self.fits(left, right)
        return known

    def piece(self, piece: str) -> list[int]:
        """The ids of one piece."""
        s = piece.encode().decode("latin-1")
        whole = self.ids.get(s)
        if whole is not None:
            return [whole]
        out = [i for _, i in self.longest(s)]
        known, last = self.compatible, -1
        for k, i in enumerate(out):
            if last >= 0 and not (known.get(last << 32 | i) or self._fits(last, i)):
                return self._backtrack(s, out[:k], i)
            last = i
        return out

    def _backtrack(self, s: str, out: list[int], token: int) -> list[int]:
        """``out`` are compatible longest matches, and ``token`` the longest match after them."""
        n, size, shorter, fits, longest, reach = len(s), self.size, self.shorter, self._fits, self.longest, self.reach
        known = self.compatible
        shut = set()  # positions from which the rest can't be covered
        at = sum(map(size.__getitem__, out))
        while True:
            end = at + size[token]
            if end not in shut and (not out or (fits(out[-1], token) if (fit := known.get(out[-1] << 32 | token)) is None else fit)):
                out.append(token)
                if end == n:
                    return out
                at, token = end, next(longest(s[end:end + reach]))[1]
            elif (less := shorter[token]) is not None:
                token = less
            else:
                shut.add(at)
                token = out.pop()
                at -= size[token]

    def _pieces(self, part: str) -> list[int]:
        """The ids of a part of the text that begins and ends where pieces do."""
        memo, out = self.memo, []
        for piece in self.split(part):
            ids = memo.get(piece)
            if ids is None:
                ids = self.older.get(piece) or tuple(self.piece(piece))
                if len(piece) <= MEMO_CHARS:
                    if len(memo) >= MEMO:
                        self.older, self.memo = memo, {}
                        memo = self.memo
                    memo[piece] = ids
            out += ids
        return out

    def parts_of(self, text: str) -> list[tuple[int, str, bytes]]:
        """The text's parts in turn, each with its number of ids, these as decimal text, and the bytes that they decode to.

        A piece never runs past a character that is not white space into white space, so the text comes apart before
        each blank that follows such a character. The parts, words with their punctuation, are remembered whole.
        """
        if not text:
            return []
        words = text.split(" ")
        n = len(words)
        found: list = list(map(self.words.get, words))
        k, gaps = 0, False
        while True:
            try:
                # the first part has no blank before it, so what is known of its word does not count
                k = found.index(None, k) if k else 0
            except ValueError:
                break
            part = word = words[k]
            after = k + 1
            while after < n and (not part or part[-1].isspace()):
                part += " " + words[after]
                found[after], gaps = (), True
                after += 1
            if k == 0 or after > k + 1 or not word or word[-1].isspace() or len(word) > MEMO_CHARS:
                found[k] = self._entry(" " + part if k else part)
            else:
                if len(self.words) >= MEMO:
                    self.older_words, self.words = self.words, {}
                found[k] = self.words[word] = self.older_words.get(word) or self._entry(" " + word)
            k = after
        return [x for x in found if x and x[0]] if gaps or not found[0][0] else found

    def _entry(self, part: str) -> tuple[int, str, bytes]:
        # no lists: the garbage collector has to go through those again and again
        ids = self._pieces(part)
        return len(ids), " ".join(map(self.text.__getitem__, ids)), self.decode(ids)

    def encode(self, text: str) -> list[int]:
        """The ids of a text."""
        return list(map(int, " ".join([x[1] for x in self.parts_of(text)]).split()))

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))


def _shipped(df: DataFrame, path: str, pattern: str):
    ranks = read_ranks(path)
    key = hashlib.sha256(repr((pattern, sorted(ranks.items()))).encode()).hexdigest()
    shipped = df.sparkSession.sparkContext.broadcast(ranks)
    return lambda: held(key, lambda: Codec(shipped.value, pattern))


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "ids", pattern: str = PATTERN) -> DataFrame:
    """``df`` with the column ``ids`` (array of int): the whole text's ids; a null text has none, like an empty one.

    A text is encoded where it lies: no shuffle. Rows and other columns stay as they are, repeated rows included; an
    existing column ``ids`` is an error.
    """
    need(df, text)
    clash(df, ids)
    codec = _shipped(df, path, pattern)
    schema = df.withColumn(ids, F.lit(None).cast("array<int>")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec()
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                made = pa.array([own.encode(t) if t else [] for t in part.column(text).to_pylist()], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*part.columns, made], names=[*part.schema.names, ids])

    return df.mapInArrow(run, schema)


def decode(df: DataFrame, path: str, ids: str = "ids", into: str = "decoded", pattern: str = PATTERN) -> DataFrame:
    """``df`` with the column ``into`` (binary): the bytes that ``ids`` stand for; null ids give empty bytes. An id that the vocabulary
    lacks is an error, and so is a column ``into`` that is there before. No rows give none."""
    need(df, ids)
    clash(df, into)
    codec = _shipped(df, path, pattern)
    schema = df.withColumn(into, F.lit(None).cast("binary")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec()
        for batch in batches:
            made = pa.array([own.decode(x or ()) for x in batch.column(ids).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, made], names=[*batch.schema.names, into])

    return df.mapInArrow(run, schema)


def digests(df: DataFrame, path: str, key: str = "doc_id", text: str = "text", pattern: str = PATTERN) -> DataFrame:
    """Per row: ``key``, n_tokens, ids_sha256 (of the decimal ids joined by one space), decoded_sha256 (of the decoded bytes).

    Encoding and decoding in one pass, so ids do not travel between Spark and Python. Null and empty texts: no ids, and the
    digests of nothing. A null key stays null; repeated rows each give a row, and no rows none. Other columns do not matter.
    """
    need(df, key, text)
    clash(df.select(key), "n_tokens", "ids_sha256", "decoded_sha256")
    codec = _shipped(df, path, pattern)
    none = F.lit(None)
    schema = df.select(key).withColumns({"n_tokens": none.cast("bigint"), "ids_sha256": none.cast("string"), "decoded_sha256": none.cast("string")}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec()
        for batch in batches:
            counts, left, right = [], [], []
            for t in batch.column(1):
                parts = own.parts_of(t.as_py() or "")
                counts.append(sum([x[0] for x in parts]))
                left.append(hashlib.sha256(" ".join([x[1] for x in parts]).encode()).hexdigest())
                right.append(hashlib.sha256(b"".join([x[2] for x in parts])).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(left, pa.string()), pa.array(right, pa.string())], names=[key, "n_tokens", "ids_sha256", "decoded_sha256"])

    return df.select(key, text).mapInArrow(run, schema)
