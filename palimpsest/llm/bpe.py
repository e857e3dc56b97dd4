"""Byte-level BPE by merge replay over distinct words.

Texts are cut into segments, a blank or a run of white space and what follows it up to the next blank or white space,
which no match of the tokenizer's pattern crosses. A chunk of documents is encoded through its distinct segments: their
distinct pattern matches, the words, are laid out in one array of symbols with links to both neighbours, and an inverted
index leads from a pair of tokens to its positions in the words. Merges are applied in rank order, each at all positions
of its pairs at once; only the touched neighbours' pairs are looked up again and enter the index.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: White space as the pattern's \s has it: the property White_Space. Fixed values.
SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
#: White space before a blank: only then may a match of the pattern go on over the blank.
WIDE = re.compile(f"[{SPACE}] ")
#: Words that are one match of the pattern for sure: letters of the first 256 code points, after a blank or not.
ONE = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+").fullmatch
SEGMENT = regex.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
NONE = np.int32(2**31 - 1)
#: Fewer positions than this are merged one by one, which is quicker than array operations on them.
FEW = 24


class Vocabulary:
    """Ranks of a tiktoken file, and which pairs of tokens merge to which token."""

    def __init__(self, path: str, pattern: str = public_tokenizers.PATTERN):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bytes = [b""] * (max(self.ranks.values()) + 1)
        self.digits = list(map(str, range(len(self.bytes))))
        for token, rank in self.ranks.items():
            self.bytes[rank] = token
        self.of_byte = np.array([self.ranks[bytes([i])] for i in range(256)], dtype=np.int32)
        self.pattern = regex.compile(pattern.replace(r"[^\s", f"[^{SPACE}").replace(r"\s", f"[{SPACE}]").replace(r"\S", f"[^{SPACE}]"))
        self.pairs = {(self.ranks[t[:i]], self.ranks[t[i:]]): r for t, r in self.ranks.items() for i in range(1, len(t)) if t[:i] in self.ranks and t[i:] in self.ranks}
        keys = np.fromiter((a << 32 | b for a, b in self.pairs), dtype=np.int64, count=len(self.pairs))
        order = np.argsort(keys)
        self.keys, self.merged = keys[order], np.fromiter(self.pairs.values(), dtype=np.int32, count=len(self.pairs))[order]

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank that each pair merges to, or NONE."""
        key = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.merged[at], NONE)

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        """The ids of each word, all words together."""
        out: list[list[int] | None] = [[self.ranks[w]] if w in self.ranks else None for w in words]
        todo = [i for i, ids in enumerate(out) if ids is None and words[i]]
        if todo:
            symbols, ends = self._replay([words[i] for i in todo])
            flat, start = symbols.tolist(), 0
            for i, end in zip(todo, ends.tolist(), strict=True):
                out[i] = flat[start:end]
                start = end
        return [ids or [] for ids in out]

    def _replay(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        ends = np.cumsum(sizes)
        symbol = self.of_byte[np.frombuffer(b"".join(words), dtype=np.uint8)]
        n = len(symbol)
        following, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        last, first = np.zeros(n, dtype=bool), np.zeros(n, dtype=bool)
        last[ends - 1], first[ends - sizes] = True, True
        following[last], before[first] = -1, -1
        rank = np.full(n, NONE, dtype=np.int32)  # of the pair that starts at a position
        inner = np.flatnonzero(~last)
        rank[inner] = self.rank_of(symbol[inner], symbol[inner + 1])
        alive = np.ones(n, dtype=bool)
        index: dict[int, list] = {}  # pair of tokens -> positions, single ones and arrays of them
        due: dict[int, list[int]] = {}  # rank -> its pairs in the index; more than one pair can make a token
        waiting: list[int] = []

        def put(pair: int, r: int, found) -> None:
            if pair not in index:
                index[pair] = []
                if r not in due:
                    due[r] = []
                    heapq.heappush(waiting, r)
                due[r].append(pair)
            index[pair].append(found)

        def enter(at: np.ndarray) -> None:
            """Put the pairs at these positions into the index."""
            at = at[rank[at] != NONE]
            pairs = symbol[at].astype(np.int64) << 32 | symbol[following[at]]
            if len(at) < FEW:
                for pair, p in zip(pairs.tolist(), at.tolist(), strict=True):
                    put(pair, int(rank[p]), p)
                return
            order = np.argsort(pairs, kind="stable")
            at, pairs = at[order], pairs[order]
            first = np.r_[0, np.flatnonzero(np.diff(pairs)) + 1]
            for pair, r, part in zip(pairs[first].tolist(), rank[at[first]].tolist(), np.split(at, first[1:]), strict=True):
                put(pair, r, part)

        enter(inner)
        while waiting:
            r = heapq.heappop(waiting)
            found = [x for pair in due.pop(r) for x in index.pop(pair)]
            parts = [x for x in found if not isinstance(x, int)]
            single = [x for x in found if isinstance(x, int)]
            at = np.unique(np.concatenate([*parts, np.array(single, dtype=np.int64)])) if parts else np.array(sorted(set(single)), dtype=np.int64)
            at = at[alive[at]]
            at = at[rank[at] == r]
            if not len(at):
                continue
            right = following[at]
            if len(at) > 1 and (right[:-1] == at[1:]).any():  # runs such as "aaa": every other position, from the left
                keep, taken = [], -1
                for p, q in zip(at.tolist(), right.tolist(), strict=True):
                    if p != taken:
                        keep.append(p)
                        taken = q
                at = np.array(keep, dtype=np.int64)
                right = following[at]
            after = following[right]
            symbol[at], following[at], alive[right], rank[right] = r, after, False, NONE
            has = after >= 0
            before[after[has]] = at[has]
            rank[at] = NONE
            rank[at[has]] = self.rank_of(symbol[at[has]], symbol[after[has]])
            left = before[at]
            left = left[left >= 0]
            rank[left] = self.rank_of(symbol[left], symbol[following[left]])
            enter(np.concatenate([at, left[~np.isin(left, at, assume_unique=True)] if len(left) else left]).astype(np.int64))
        counts = np.add.reduceat(alive, ends - sizes) if len(words) else alive
        return symbol[alive], np.cumsum(counts)


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class _Numbers(dict):
    """Numbers of segments, given as they come; ``lead`` belongs to every segment and isn't in its key."""

    def __init__(self, lead: str, fresh: list[str], known: int):
        self.lead, self.fresh, self.known = lead, fresh, known

    def __missing__(self, piece: str) -> int:
        self[piece] = n = self.known + len(self.fresh)
        self.fresh.append(self.lead + piece)
        return n


class Encoder:
    """Encodes chunks of texts; what it has found for a segment is kept for later chunks, up to ``most`` segments."""

    def __init__(self, vocab: Vocabulary, most: int = 400_000, with_ids: bool = True):
        self.vocab, self.most, self.with_ids = vocab, most, with_ids
        self.clear()

    def clear(self) -> None:
        self.fresh: list[str] = []
        self.spaced, self.plain = (_Numbers(lead, self.fresh, 0) for lead in (" ", ""))
        self.ids: list[bytes] = []  # of each segment: its ids as 4 bytes each, how many, in digits, and decoded
        self.sizes: list[int] = []
        self.digits: list[str] = []
        self.decoded: list[bytes] = []

    def chunk(self, texts: list[str]) -> list[array]:
        """The segments of each text, as numbers into ids, sizes, digits and decoded. Segments without a token have no
        digits; they only come from empty texts and blanks at a text's ends."""
        if len(self.sizes) > self.most:
            self.clear()
        docs = []
        for text in texts:
            if WIDE.search(text):
                docs.append(array("i", map(self.plain.__getitem__, SEGMENT.findall(text))))
                continue
            first, *rest = text.split(" ")
            doc = array("i", map(self.spaced.__getitem__, rest))
            if first:
                doc.insert(0, self.plain[first])
            docs.append(doc)
        words: dict[bytes, int] = {}
        match = self.vocab.pattern.findall
        parts = [[words.setdefault(m.encode(), len(words)) for m in ([s] if ONE(s, s[0] == " ") else match(s))] for s in self.fresh]
        encoded = self.vocab.encode_words(list(words))
        digits, known = self.vocab.digits, self.vocab.bytes
        for part in parts:
            ids = encoded[part[0]] if len(part) == 1 else [i for w in part for i in encoded[w]]
            self.sizes.append(len(ids))
            self.digits.append(",".join([digits[i] for i in ids]))
            self.decoded.append(b"".join([known[i] for i in ids]))
            if self.with_ids:
                self.ids.append(array("i", ids).tobytes())
        self.fresh.clear()
        self.spaced.known = self.plain.known = len(self.sizes)
        return docs


def _chunks(batches: Iterator[pd.DataFrame], text_col: str, chars: int) -> Iterator[pd.DataFrame]:
    """The same rows, in frames of about so many characters."""
    held, size = [], 0
    for batch in batches:
        lengths, start = batch[text_col].str.len().to_numpy(), 0
        for i, n in enumerate(lengths):
            size += n
            if size >= chars:
                yield pd.concat([*held, batch.iloc[start : i + 1]], ignore_index=True)
                held, size, start = [], 0, i + 1
        if start < len(lengths):
            held.append(batch.iloc[start:])
    if held:
        yield pd.concat(held, ignore_index=True)


def encode_documents(df: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text", chunk_chars: int = 24_000_000, with_ids: bool = True) -> DataFrame:
    """One row per input row: id, n_tokens, ids_sha256, decoded_sha256 and, ``with_ids``, ids.

    A null text counts as empty; an empty text has no tokens. Special tokens are ordinary text. Equal texts and rows
    that repeat are encoded alike, each in a row of its own; a null id stays null. Other columns are not read.
    decoded_sha256 is the digest of the bytes that the ids decode to. vocab_path is read where the tasks run. A task
    holds one chunk of about chunk_chars characters, or one text, and the segments found so far up to a bound.
    """
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = Encoder(vocabulary(vocab_path), with_ids=with_ids)
        for rows in _chunks(batches, "text", chunk_chars):
            number, docs = rows["id"], encoder.chunk(rows["text"].tolist())
            del rows
            size, digits, decoded, ids = encoder.sizes.__getitem__, encoder.digits.__getitem__, encoder.decoded.__getitem__, encoder.ids
            for start in range(0, len(docs), 500):
                out = []
                for doc in docs[start : start + 500]:
                    tokens = hashlib.sha256(",".join(map(digits, doc)).encode()).hexdigest()
                    bytes_ = hashlib.sha256(b"".join(map(decoded, doc))).hexdigest()
                    own = np.frombuffer(b"".join([ids[s] for s in doc]), dtype=np.int32) if with_ids else None
                    out.append((sum(map(size, doc)), tokens, bytes_, own))
                frame = pd.DataFrame(out, columns=["n_tokens", "ids_sha256", "decoded_sha256", "ids"])
                frame.insert(0, "id", number.iloc[start : start + 500].to_numpy())
                yield frame if with_ids else frame.drop(columns="ids")

    schema = "id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return docs.mapInPandas(run, schema).withColumnRenamed("id", id_col)


def decode(ids: list[int], vocab_path: str) -> bytes:
    """The bytes that the ids stand for."""
    return b"".join(map(vocabulary(vocab_path).bytes.__getitem__, ids))


def op4_bpe(spark, sf_dir: str) -> DataFrame:
    return encode_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), with_ids=False)


ORACLE: dict[str, str] = {}
QUERIES = {"op4_bpe": op4_bpe}
