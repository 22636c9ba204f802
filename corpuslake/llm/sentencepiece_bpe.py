"""Byte-fallback BPE of a SentencePiece model, encoded and decoded with numpy.

A text is cut where no piece can reach across, distinct words are looked up once, and all new words
of a batch are merged together: one flat array of symbols, in each round the best pair of every
word (leftmost among equals), merged at once in all words, until no word has a pair left.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from corpuslake.llm.registry import query, table

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6  # piece types of the format
_WORD = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
NO_RANK = (1 << 31) - 1
LONG_WORD = 48  # characters above which a word is looked through for places to cut
ROUNDS = 64  # of one merge for each word; then all places of a pair go at once
GROUP_BYTES = 2 << 20  # of text whose new words are merged together


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Fields of a protocol-buffer message: number and value."""
    at = 0

    def varint():
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            size = varint() if kind == 2 else 4 if kind == 5 else 8
            yield key >> 3, data[at : at + size]
            at += size


class Vocabulary:
    """Pieces and merge ranks of a model file.

    Only what such models use is supported: BPE, no character normalisation, white space kept and
    escaped, a space put before the text, bytes for unknown characters."""

    def __init__(self, model: bytes):
        self.pieces, self.kinds, scores = [], [], []
        normaliser: dict = {}
        for number, value in _fields(model):
            if number == 1:
                piece = dict(_fields(value))
                self.pieces.append(piece[1].decode())
                scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
                self.kinds.append(piece.get(3, NORMAL))
            elif number == 3:
                normaliser = dict(_fields(value))
        trainer = next((dict(_fields(v)) for n, v in _fields(model) if n == 2), {})
        if (normaliser.get(2) or normaliser.get(3, 1) != 1 or normaliser.get(4, 1) != 0
                or trainer.get(3) != 2 or not trainer.get(35) or {USER, UNUSED} & set(self.kinds)):
            raise ValueError("this kind of SentencePiece model is not supported")
        self.n = len(self.pieces)
        ids = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds)) if k == NORMAL}
        if any(SPACE in p.lstrip(SPACE) for p in ids):
            raise ValueError("a piece runs across words")
        self.char_ids = {p: i for p, i in ids.items() if len(p) == 1}
        self.char_table = np.full(0x110000, -1, np.int64)
        for c, i in self.char_ids.items():
            self.char_table[ord(c)] = i
        self.byte_ids = np.zeros(256, np.int64)
        for i, k in enumerate(self.kinds):
            if k == BYTE:
                self.byte_ids[int(self.pieces[i][3:5], 16)] = i
        levels = {s: r for r, s in enumerate(sorted({scores[i] for i in ids.values()}, reverse=True))}
        self.rank = np.full(self.n, NO_RANK, np.int64)
        for i in ids.values():
            self.rank[i] = levels[scores[i]]

        pairs, self.inside = {}, set()
        self.together = np.zeros(self.n, bool)  # all places of this merge may go in one round
        self.together[list(ids.values())] = True
        for p, i in ids.items():
            self.inside.update(zip(p, p[1:]))
            for k in range(1, len(p)):
                left, right = ids.get(p[:k]), ids.get(p[k:])
                if left is not None and right is not None:
                    pairs[left * self.n + right] = i
                    for part in (left, right):
                        if self.rank[i] <= self.rank[part]:
                            self.together[part] = False
        keys = np.array(sorted(pairs), np.int64)
        self.pair_keys = np.append(keys, np.iinfo(np.int64).max)
        self.pair_ids = np.array([pairs[k] for k in keys.tolist()] + [0], np.int64)
        # A run of spaces is cut after so many, if all pieces of spaces are equal and come last.
        runs = [p for p in ids if len(p) > 1 and not p.strip(SPACE)]
        alike = {self.rank[ids[p]] for p in runs} == {max(levels.values())}
        self.space_run = max(map(len, runs)) if runs and alike else 0
        if self.space_run and self._spaces(3 * self.space_run) != [self.space_run] * 3:
            self.space_run = 0
        self.numbers = _table([b"%d," % i for i in range(self.n)])
        self.texts = _table([
            bytes([int(p[3:5], 16)]) if k == BYTE else b"" if k == CONTROL
            else b" \xe2\x81\x87 " if k == UNKNOWN else p.replace(SPACE, " ").encode()
            for p, k in zip(self.pieces, self.kinds)])

    def _spaces(self, n: int) -> list[int]:
        ids, _ = self._merge([SPACE * n])
        return [len(self.pieces[i]) for i in ids]

    # --- encoding ------------------------------------------------------------

    def _segments(self, word: str) -> list[str]:
        """Cut a long word between characters that stand together in no piece."""
        cuts = [k for k in range(1, len(word)) if (word[k - 1], word[k]) not in self.inside]
        spaces = len(word) - len(word.lstrip(SPACE))
        if self.space_run:
            cuts += range(self.space_run, spaces, self.space_run)
        cuts = [0, *sorted(set(cuts)), len(word)]
        return [word[a:b] for a, b in zip(cuts, cuts[1:])]

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all words, and how many each has; all are merged together."""
        if not any(len(w) > LONG_WORD for w in words):
            return self._merge(words)
        parts = [self._segments(w) if len(w) > LONG_WORD else [w] for w in words]
        ids, sizes = self._merge([s for p in parts for s in p])
        return ids, np.add.reduceat(sizes, np.cumsum([0] + [len(p) for p in parts[:-1]]))

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merged id (-1: none) and rank of pairs of symbols."""
        keys = np.where((left < 0) | (right < 0), -1, left * self.n + right)
        at = np.searchsorted(self.pair_keys, keys)
        merged = np.where(self.pair_keys[at] == keys, self.pair_ids[at], -1)
        return merged, np.where(merged >= 0, self.rank[merged], NO_RANK)

    def _merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids, and the number of ids of each word (none is empty).

        A character without a piece is a negative symbol until its bytes replace it."""
        if not words:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        symbols = self.char_table[codes]
        symbols = np.where(symbols < 0, -1 - codes, symbols)
        sizes = np.array([len(w) for w in words])
        names = np.arange(len(words))
        starts = np.cumsum(sizes) - sizes
        merged, rank = self._pairs(symbols, np.append(symbols[1:], -1))
        rank[starts[1:] - 1] = NO_RANK
        done = []
        for _ in range(ROUNDS):
            # Rank and place in one number: its minimum is the leftmost of the best pairs.
            best = np.minimum.reduceat((rank << 32) + np.arange(len(rank)), starts)
            live = (best >> 32) != NO_RANK
            n_live = int(live.sum())
            if n_live < 0.6 * len(live):
                own = np.repeat(live, sizes)
                done.append((names[~live], sizes[~live], symbols[~own]))
                symbols, merged, rank = symbols[own], merged[own], rank[own]
                names, sizes = names[live], sizes[live]
                starts = np.cumsum(sizes) - sizes
                if not n_live:
                    break
                continue
            hit = best[live] & 0xFFFFFFFF
            symbols[hit] = merged[hit]
            stay = np.ones(len(symbols), bool)
            stay[hit + 1] = False
            merged[hit], rank[hit] = merged[hit + 1], rank[hit + 1]
            symbols, merged, rank = symbols[stay], merged[stay], rank[stay]
            hit -= np.arange(len(hit))
            sizes = sizes - live
            starts = np.cumsum(sizes) - sizes
            first, last = starts[live], (starts + sizes - 1)[live]
            for at in (hit[hit < last], hit[hit > first] - 1):
                merged[at], rank[at] = self._pairs(symbols[at], symbols[at + 1])
        if len(names) and len(symbols):
            symbols, owner = self._merge_long(symbols, np.repeat(np.arange(len(names)), sizes))
            done.append((names, np.bincount(owner, minlength=len(names)), symbols))
        names = np.concatenate([d[0] for d in done])
        sizes = np.concatenate([d[1] for d in done])
        ids = np.concatenate([d[2] for d in done])
        order = np.argsort(names, kind="stable")
        starts = (np.cumsum(sizes) - sizes)[order]
        sizes = sizes[order]
        ids = ids[np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(ids))]
        unknown = np.flatnonzero(ids < 0)
        if unknown.size:
            raw = [chr(-1 - c).encode("utf-8", "surrogatepass") for c in ids[unknown].tolist()]
            copies = np.ones(len(ids), np.int64)
            copies[unknown] = [len(b) for b in raw]
            owner = np.repeat(np.repeat(np.arange(len(words)), sizes), copies)
            ids = np.repeat(ids, copies)
            ids[ids < 0] = self.byte_ids[np.frombuffer(b"".join(raw), np.uint8)]
            sizes = np.bincount(owner, minlength=len(words))
        return ids, sizes

    def _merge_long(self, symbols: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Finish words of many symbols: where no later pair can overtake it, a round merges all
        places of a word's best pair, not only the leftmost. Gives symbols and their words."""
        out = []
        place = np.arange(len(symbols))
        while len(symbols):
            ends = np.append(word[1:] != word[:-1], True)
            merged, rank = self._pairs(symbols, np.where(ends, -1, np.append(symbols[1:], -1)))
            starts = np.flatnonzero(np.append(True, ends[:-1]))
            best = np.repeat(np.minimum.reduceat(rank, starts), np.diff(np.append(starts, len(word))))
            finished = best == NO_RANK
            if finished.any():
                out.append((place[finished], symbols[finished], word[finished]))
                symbols, word, place, rank, best, merged = (
                    x[~finished] for x in (symbols, word, place, rank, best, merged))
                if not len(symbols):
                    break
            hit = np.flatnonzero(rank == best)
            lead = np.append(True, word[hit][1:] != word[hit][:-1])
            lead_at = np.flatnonzero(lead)[np.cumsum(lead) - 1]
            hit = hit[lead | (self.together[merged[hit]] & (merged[hit] == merged[hit][lead_at]))]
            # Of hits that touch, every second one from the left of their run.
            run = np.append(True, (np.diff(hit) != 1) | (word[hit][1:] != word[hit][:-1]))
            hit = hit[(np.arange(len(hit)) - np.flatnonzero(run)[np.cumsum(run) - 1]) % 2 == 0]
            symbols[hit] = merged[hit]
            stay = np.ones(len(symbols), bool)
            stay[hit + 1] = False
            symbols, word, place = symbols[stay], word[stay], place[stay]
        order = np.argsort(np.concatenate([o[0] for o in out]), kind="stable")
        return np.concatenate([o[1] for o in out])[order], np.concatenate([o[2] for o in out])[order]

    # --- decoding ------------------------------------------------------------

    def decode(self, ids: np.ndarray, at: np.ndarray) -> Iterator[bytes | memoryview]:
        """Texts of flat ids with the bounds of each. The space put before a text goes, and bytes
        that are no UTF-8 become U+FFFD, one for each."""
        for raw in _joined(self.texts, ids, at):
            raw = raw[1:] if raw[:1] == b" " else raw
            try:
                str(raw, "utf-8")
                yield raw
            except UnicodeDecodeError:
                yield str(raw, "utf-8", _ONE_EACH).encode()

    def digits(self, ids: np.ndarray, at: np.ndarray) -> Iterator[memoryview]:
        """Ids in decimal, a comma after each."""
        return _joined(self.numbers, ids, at)


def _table(values: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sizes = np.array([len(v) for v in values])
    return np.frombuffer(b"".join(values), np.uint8), np.cumsum(sizes) - sizes, sizes


def _joined(of, ids: np.ndarray, at: np.ndarray) -> Iterator[memoryview]:
    """For each text the bytes of its ids, one after the other."""
    values, starts, sizes = of
    own = sizes[ids]
    flat = memoryview(gather(values, starts[ids], own))
    ends = np.append(0, np.cumsum(own))[at].tolist()
    for a, b in zip(ends, ends[1:]):
        yield flat[a:b]


_ONE_EACH = "one-replacement-for-each-byte"


def _replace_each(error: UnicodeError):
    return "�" * (error.end - error.start), error.end


def _register() -> None:
    import codecs

    codecs.register_error(_ONE_EACH, _replace_each)


_register()
_LOADED: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    if path not in _LOADED:
        with open(path, "rb") as f:
            _LOADED[path] = Vocabulary(f.read())
    return _LOADED[path]


def gather(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All ``values[start : start + size]``, one after the other."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return values[np.repeat(starts - (ends - sizes), sizes) + np.arange(total)]


def bounds(sizes: np.ndarray, owners: np.ndarray) -> np.ndarray:
    """Where each owner's share of the flat values begins; owners have so many sizes each."""
    ends = np.append(0, np.cumsum(sizes))
    return ends[np.append(0, np.cumsum(owners))]


class Encoder:
    """Encodes texts; keeps the ids of words it has seen, up to ``memory`` words."""

    def __init__(self, vocab: Vocabulary, memory: int = 300_000):
        self.vocab, self.memory = vocab, memory
        self._forget()

    def _forget(self) -> None:
        self.seen: dict[str, int] = {}
        self.ids = np.zeros(0, np.int32)
        self.starts = self.sizes = np.zeros(0, np.int64)

    def _learn(self, words: list[str]) -> None:
        ids, sizes = self.vocab.encode_words(words)
        self.starts = np.append(self.starts, len(self.ids) + np.cumsum(sizes) - sizes)
        self.sizes = np.append(self.sizes, sizes)
        self.ids = np.append(self.ids, ids.astype(np.int32))
        self.seen.update(zip(words, range(len(self.seen), len(self.seen) + len(words))))

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all texts, and the bounds of each text's ids (one more than texts).
        New words of all the texts are merged in one go; null counts as empty."""
        own = [_WORD.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        flat = list(chain.from_iterable(own))
        different = set(flat)
        new = different.difference(self.seen)
        if len(self.seen) + len(new) > self.memory:
            self._forget()
            new = different
        if new:
            self._learn(list(new))
        at = np.fromiter(map(self.seen.__getitem__, flat), np.int64, len(flat))
        sizes = self.sizes[at]
        return gather(self.ids, self.starts[at], sizes), bounds(sizes, np.array([len(w) for w in own], np.int64))


def groups(batch: pa.RecordBatch, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``GROUP_BYTES`` of text."""
    at = size = 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(batch[column]), 0).to_pylist()):
        size += n
        if size >= GROUP_BYTES:
            yield batch.slice(at, i + 1 - at)
            at, size = i + 1, 0
    if at < batch.num_rows:
        yield batch.slice(at)


def encode(docs: DataFrame, model_path: str, *keep: str, with_decoded: bool = True) -> DataFrame:
    """Adds ``ids array<int>`` (and ``decoded``, the text those ids give) to the kept columns.

    Whole texts; a null text counts as empty and gets no ids and an empty text. ``model_path`` has
    to exist on every executor. Repeated rows are encoded one by one."""
    source = docs.select(*dict.fromkeys((*keep, "text")))
    kinds = dict(source.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary(model_path))
        for whole in batches:
            for batch in groups(whole):
                ids, at = encoder.encode(batch["text"].to_pylist())
                columns = [batch[c] for c in keep]
                columns.append(pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids)))
                if with_decoded:
                    columns.append(pa.array(
                        [str(t, "utf-8") for t in encoder.vocab.decode(ids, at)], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, [*keep, "ids", *["decoded"] * with_decoded])

    return source.mapInArrow(run, "".join(f"`{c}` {kinds[c]}, " for c in keep)
                             + "ids array<int>" + ", decoded string" * with_decoded)


def digests(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: what ``encode`` gives, without shipping it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary(model_path))
        for whole in batches:
            for batch in groups(whole):
                ids, at = encoder.encode(batch["text"].to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"], pa.array(np.diff(at)),
                     pa.array([hashlib.sha256(x[:-1]).hexdigest()
                               for x in encoder.vocab.digits(ids, at)], pa.string()),
                     pa.array([hashlib.sha256(x).hexdigest()
                               for x in encoder.vocab.decode(ids, at)], pa.string())],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {dict(docs.dtypes)['doc_id']}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@query("op5_sentencepiece")
def op5_sentencepiece(spark, sf_dir):
    return digests(table(spark, sf_dir, "documents"), default_model())
