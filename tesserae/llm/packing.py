"""Lexical retrieval packing: a sharded BM25 index fills each sequence with neighbours of its seed.

Texts are tokenized once and stored.  Token ids are the index terms, so the
document frequencies of all texts are one array of the vocabulary's size.  A
text goes to the shard of its rarest token; shards hold about SHARD_TOKENS, a
token with more is split by a hash of the text, and the plan of shards, too, has
the vocabulary's size.  Full windows of long texts are sequences of their own;
only what is left over is shuffled.  A shard's task indexes its texts, takes the
first unused one as seed, retrieves unused neighbours by BM25 over all of the
seed's tokens and appends them until the window is full; the last is cut, and
its rest is the next seed.  So a shard pads one sequence at most.

Nulls and odd cases: a null or empty text is its end id alone.  Each row is a
document of its own, repeated rows too; null ids stay null.  Texts of any length
are tokenized whole.  An empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm.storage import documents, stored
from tesserae.llm.wordhash import Words, parts, released

WINDOW = 4096
END_ID = 2
SHARD_TOKENS = 1 << 20
#: BM25 parameters.
K1, B = 1.2, 0.75
#: Ids fit into 16 bits; a larger vocabulary is refused.
MOST_IDS = 1 << 16
#: Text bytes tokenized at a time.
TOKENIZED_BYTES = 4 << 20
#: Distinct word pieces that a Python worker remembers at most, and twice as many words.
REMEMBERED = 500_000


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


# --- tokens ----------------------------------------------------------------------------------------------------------

#: Words of these characters alone are split here as the tokenizer splits them, and their pieces are remembered.
_SIMPLE = re.compile(r"[!-&(-;=-~À-ÖØ-öø-ÿ]+")
_PIECES = re.compile(r"[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")


class TokenMemory:
    """Ids of texts, by distinct words: no token of this tokenizer spans white space.

    Words are looked up by a 64-bit hash, and then compared byte by byte; where
    two words share a hash, their texts are tokenized whole.  A simple word is
    lower-cased and split into pieces, whose ids do not depend on each other;
    pieces are tokenized once, many at a time, since the last token of each
    carries the end mark.  Any other word is tokenized whole.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.size = max(vocabulary.values()) + 1
        if self.size > MOST_IDS:
            raise ValueError(f"ids up to {self.size - 1} do not fit into 16 bits")
        self.ends = np.zeros(self.size, dtype=bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.clear()

    def clear(self) -> None:
        self.pieces: dict[str, int] = {}
        self.piece_counts, self.piece_flat = np.empty(0, np.int64), np.empty(0, np.uint16)
        # words by hash, sorted, and their slots, by which their bytes and where their ids stand are known
        self.hashes, self.slot = np.empty(0, np.uint64), np.empty(0, np.int64)
        self.letters, self.letter_starts = np.empty(0, np.uint8), np.zeros(1, np.int64)
        self.starts, self.counts, self.flat = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint16)

    def _learn_pieces(self, pieces: list[str], words: list[str]) -> None:
        counts, flat = [self.piece_counts], [self.piece_flat]
        if pieces:
            lines = [" ".join(pieces[k : k + 1000]) for k in range(0, len(pieces), 1000)]
            ids = np.concatenate([np.array(e.ids, np.uint16) for e in self.tokenizer.encode_batch_fast(lines, add_special_tokens=False)])
            ends = np.flatnonzero(self.ends[ids])
            if len(ends) != len(pieces):
                raise ValueError("the tokenizer does not end each word piece with its end mark")
            counts.append(np.diff(ends, prepend=-1))
            flat.append(ids)
        for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False) if words else []:
            counts.append(np.array([len(e.ids)]))
            flat.append(np.array(e.ids, np.uint16))
        for x in (*pieces, *(w + " " for w in words)):
            self.pieces[x] = len(self.pieces)
        self.piece_counts, self.piece_flat = np.concatenate(counts), np.concatenate(flat)

    def _learn(self, hashes: np.ndarray, found: list[bytes]) -> None:
        self.letters = np.concatenate([self.letters, np.frombuffer(b"".join(found), np.uint8)])
        self.letter_starts = np.concatenate([self.letter_starts, self.letter_starts[-1] + np.cumsum([len(w) for w in found])])
        words = [w.decode() for w in found]
        # an unusual word is known under its own text with a space, which no piece has
        split = [_PIECES.findall(w.lower()) if _SIMPLE.fullmatch(w) else [w + " "] for w in words]
        new = dict.fromkeys(p for ps in split for p in ps if p not in self.pieces)
        self._learn_pieces([p for p in new if p[-1] != " "], [p[:-1] for p in new if p[-1] == " "])
        known = self.pieces
        part = np.array([known[p] for ps in split for p in ps], np.int64)
        counts = self.piece_counts[part]
        ends = np.cumsum(counts)[np.cumsum([len(ps) for ps in split]) - 1]
        begins = np.concatenate([[0], ends[:-1]])
        place = np.searchsorted(self.hashes, hashes)
        self.hashes = np.insert(self.hashes, place, hashes)
        self.slot = np.insert(self.slot, place, np.arange(len(words)) + len(self.starts))
        self.starts = np.concatenate([self.starts, begins + len(self.flat)])
        self.counts = np.concatenate([self.counts, ends - begins])
        self.flat = np.concatenate([self.flat, self.piece_flat[_spread((np.cumsum(self.piece_counts) - self.piece_counts)[part], counts)]])

    def _remembered(self, words: Words, own: np.ndarray, slots: np.ndarray) -> bool:
        """Whether the given words have the bytes of the slots that their hashes led to."""
        size = words.end[own] - words.start[own]
        if (size != self.letter_starts[slots + 1] - self.letter_starts[slots]).any():
            return False
        return bool((words.data[_spread(words.start[own], size)] == self.letters[_spread(self.letter_starts[slots], size)]).all())

    def _whole(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """ids without the help of words."""
        own = [[*e.ids, END_ID] for e in self.tokenizer.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
        return np.cumsum([0, *map(len, own)]), np.array([i for ids in own for i in ids], np.uint16)

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(starts, ids) of texts without nulls, END_ID after each; starts has the end appended."""
        if len(self.pieces) > REMEMBERED or len(self.hashes) > 2 * REMEMBERED:
            self.clear()
        words = Words(texts)
        distinct, first, inverse = np.unique(words.hash, return_index=True, return_inverse=True)
        at = np.searchsorted(self.hashes, distinct)
        new = np.ones(len(distinct), dtype=bool)
        if len(self.hashes):
            new = self.hashes[np.minimum(at, len(self.hashes) - 1)] != distinct
        known = self.slot[at[~new]]
        if not (words.same(first[inverse]).all() and self._remembered(words, first[~new], known)):
            return self._whole(texts)
        if new.any():
            data = words.data
            fresh = first[new]
            self._learn(distinct[new], [data[s:e].tobytes() for s, e in zip(words.start[fresh].tolist(), words.end[fresh].tolist())])
            at = np.searchsorted(self.hashes, distinct)
        slot = self.slot[at][inverse]
        # an end id after each text's last word
        ends = words.first + words.count
        counts = np.insert(self.counts[slot], ends, 1)
        out = np.append(self.flat, np.uint16(END_ID))[_spread(np.insert(self.starts[slot], ends, len(self.flat)), counts)]
        sums = np.concatenate([[0], np.cumsum(counts)])
        return np.concatenate([[0], sums[ends + np.arange(1, len(texts) + 1)]]), out


def _spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The indices start, start + 1, ... of each range, one range after the other."""
    total = int(counts.sum())
    if not total:
        return np.empty(0, np.int64)
    shift = starts - (np.cumsum(counts) - counts)
    return np.arange(total) + np.repeat(shift, counts)


_memories: dict[str, TokenMemory] = {}


def memory(path: str) -> TokenMemory:
    """The worker's own memory of a tokenizer."""
    if path not in _memories:
        _memories[path] = TokenMemory(path)
    return _memories[path]


def _tokenize(path: str) -> Callable:
    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch, "text", most=TOKENIZED_BYTES):
                starts, ids = memory(path).ids(part.column("text").fill_null(""))
                blobs = pa.Array.from_buffers(pa.large_binary(), len(part), [None, pa.py_buffer((starts * 2).astype(np.int64).tobytes()), pa.py_buffer(ids.tobytes())])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), blobs.cast(pa.binary())], names=["doc_id", "ids"])

    return run


def tokenized(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids): little-endian 16-bit ids of each text of docs (doc_id, text), END_ID at the end."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(_tokenize(path), "doc_id long, ids binary")


# --- statistics over all texts ---------------------------------------------------------------------------------------


def _ids_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ids) of a batch with a column ids."""
    column = batch.column("ids").cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return (at - at[0]) // 2, np.frombuffer(data, np.uint8)[at[0] : at[-1]].view(np.uint16) if len(column) else np.empty(0, np.uint16)


def _document_frequencies(size: int) -> Callable:
    """Partial counts: for each partition one row per token that it has."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, texts, tokens = np.zeros(size + 2, np.int64), 0, 0
        for batch in batches:
            for lo in range(0, batch.num_rows, 128):
                starts, ids = _ids_of(batch.slice(lo, 128))
                seen = np.zeros((len(starts) - 1, size), dtype=bool)
                seen[np.repeat(np.arange(len(starts) - 1), np.diff(starts)), ids] = True
                counts[:size] += seen.sum(axis=0)
                texts += len(starts) - 1
                tokens += len(ids)
        counts[size], counts[size + 1] = texts, tokens
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some])], names=["token", "n"])

    return run


def document_frequencies(tokens: DataFrame, size: int) -> tuple[np.ndarray, int, int]:
    """(documents with each id, documents, tokens) over all texts: as many rows as the vocabulary reach the driver."""
    rows = tokens.select("ids").mapInArrow(_document_frequencies(size), "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(size + 2, np.int64)
    out[rows["token"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)
    return out[:size], int(out[size]), int(out[size + 1])


def _routes(starts: np.ndarray, ids: np.ndarray, frequency: np.ndarray) -> np.ndarray:
    """Each text's rarest token, the smallest of equally rare ones."""
    rank = (frequency[ids].astype(np.int64) << 16) | ids
    return (np.minimum.reduceat(rank, starts[:-1]) & 0xFFFF) if len(starts) > 1 else np.empty(0, np.int64)


def _route_sizes(frequency: np.ndarray, window: int) -> Callable:
    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(len(frequency), np.int64)
        for batch in batches:
            starts, ids = _ids_of(batch)
            np.add.at(sums, _routes(starts, ids, frequency), np.diff(starts) % window + 1)
        some = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(sums[some])], names=["token", "n"])

    return run


def shard_plan(sizes: np.ndarray, shard_tokens: int) -> tuple[np.ndarray, np.ndarray]:
    """(first shard, number of shards) of each route: small routes share a shard, large ones are split."""
    split = np.maximum(1, -(-sizes // shard_tokens))
    first, shard, held = np.zeros(len(sizes), np.int64), 0, 0
    for r in np.flatnonzero(sizes):
        if held and held + sizes[r] > shard_tokens:
            shard, held = shard + 1, 0
        first[r] = shard
        if split[r] > 1:
            shard, held = shard + int(split[r]), 0
        else:
            held += int(sizes[r])
    return first, split


# --- packing ---------------------------------------------------------------------------------------------------------

PIECE = "shard long, route int, doc_id long, start long, length long, crc long, doc_tokens long, ids binary"
OUT = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def crc32(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def _deal(frequency: np.ndarray, first: np.ndarray, split: np.ndarray, window: int) -> Callable:
    """Whole windows of a text, with their checksum only, and its rest, with its ids, for the text's shard."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = 0  # rows so far, which deal equal rows out; the stored table gives a task the same rows again
        for batch in batches:
            starts, ids = _ids_of(batch)
            route = _routes(starts, ids, frequency)
            docs = batch.column("doc_id").to_pylist()
            rows: list[tuple] = []
            for i, doc in enumerate(docs):
                own = ids[starts[i] : starts[i + 1]]
                r = int(route[i])
                shard = int(first[r]) + (zlib.crc32(own.tobytes() + f"{doc} {done}".encode()) % int(split[r]) if split[r] > 1 else 0)
                done += 1
                whole = len(own) // window * window
                rows += [(shard, r, doc, s, window, crc32(own[s : s + window]), len(own), None) for s in range(0, whole, window)]
                if whole < len(own):
                    rows.append((shard, r, doc, whole, len(own) - whole, 0, len(own), own[whole:].tobytes()))
                if len(rows) >= 4096 or i == len(docs) - 1:
                    yield _batch(rows, PIECE_TYPES)
                    rows = []

    return run


PIECE_TYPES = {"shard": pa.int64(), "route": pa.int32(), "doc_id": pa.int64(), "start": pa.int64(), "length": pa.int64(), "crc": pa.int64(), "doc_tokens": pa.int64(), "ids": pa.binary()}
OUT_TYPES = {"doc_id": pa.int64(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64(), "doc_tokens": pa.int64(), "sequence_id": pa.int64(), "offset": pa.int64()}


def _batch(rows: list[tuple], types: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types.values())], names=list(types))


class ShardIndex:
    """BM25 postings of a shard's texts: for each token the texts that have it, with the weight of the token in each."""

    def __init__(self, texts: list[np.ndarray], frequency: np.ndarray, n_texts: int, mean_length: float) -> None:
        size = np.array([len(t) for t in texts])
        key = np.repeat(np.arange(len(texts)), size).astype(np.int64) << 16 | np.concatenate(texts)
        key, tf = np.unique(key, return_counts=True)
        text, token = key >> 16, key & 0xFFFF
        idf = np.log1p((n_texts - frequency[token] + 0.5) / (frequency[token] + 0.5))
        weight = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size[text] / mean_length))
        order = np.argsort(token, kind="stable")
        self.text, self.weight = text[order], weight[order]
        self.bounds = np.searchsorted(token[order], np.arange(MOST_IDS + 1))
        # the tokens of each text; one that no other text of the shard has finds nothing
        several = np.diff(self.bounds)[token] > 1
        self.tokens, self.begins = token[several], np.searchsorted(text[several], np.arange(len(texts) + 1))
        self.n = len(texts)

    def neighbours(self, seed: int, used: np.ndarray) -> np.ndarray:
        """Unused texts that share a token with the seed, by falling score, equal ones in the shard's order."""
        own = self.tokens[self.begins[seed] : self.begins[seed + 1]]
        at = _spread(self.bounds[own], self.bounds[own + 1] - self.bounds[own])
        scores = np.bincount(self.text[at], weights=self.weight[at], minlength=self.n)
        scores[used] = 0
        some = np.flatnonzero(scores)
        return some[np.argsort(-scores[some], kind="stable")]


def _pack_shard(shard: int, rows: list[tuple], frequency: np.ndarray, n_texts: int, mean_length: float, window: int) -> Iterator[tuple]:
    """Output rows of one shard.  rows: (doc_id, start, length, crc, doc_tokens, ids or None)."""
    sequence = shard << 32
    rests = []
    for doc, start, length, crc, doc_tokens, ids in rows:
        if ids is None:
            yield doc, start, length, crc, doc_tokens, sequence, 0
            sequence += 1
        else:
            rests.append((doc, start, doc_tokens, np.frombuffer(ids, np.uint16)))
    if not rests:
        return
    index = ShardIndex([r[3] for r in rests], frequency, n_texts, mean_length)
    used = np.zeros(len(rests), dtype=bool)
    offset, next_, carried = 0, 0, None  # carried: a text and how many of its ids are placed

    def place(k: int, done: int) -> tuple[tuple, int]:
        doc, start, doc_tokens, ids = rests[k]
        piece = ids[done : done + window - offset]
        return (doc, start + done, len(piece), crc32(piece), doc_tokens, sequence, offset), done + len(piece)

    while True:
        if carried is None:
            while next_ < len(rests) and used[next_]:
                next_ += 1
            if next_ == len(rests):
                return
            carried = next_, 0
            used[next_] = True
        seed, done = carried
        row, done = place(seed, done)
        yield row
        offset += row[2]
        carried = None
        wanted = iter(index.neighbours(seed, used)) if offset < window else iter(())
        while offset < window:
            k = next(wanted, None)
            if k is None:  # no neighbour is left: the next in the shard's order, which has the nearest routes
                while next_ < len(rests) and used[next_]:
                    next_ += 1
                if next_ == len(rests):
                    return
                k = next_
            used[k] = True
            row, done = place(k, 0)
            yield row
            offset += row[2]
            if done < len(rests[k][3]):
                carried = k, done
        sequence, offset = sequence + 1, 0


def _pack(frequency: np.ndarray, n_texts: int, mean_length: float, window: int) -> Callable:
    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, rows = None, []
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("shard", "doc_id", "start", "length", "crc", "doc_tokens", "ids")]
            for s, *row in zip(*columns):
                if s != shard:
                    if rows:
                        yield _batch(list(_pack_shard(shard, rows, frequency, n_texts, mean_length, window)), OUT_TYPES)
                    shard, rows = s, []
                rows.append(tuple(row))
        if rows:
            yield _batch(list(_pack_shard(shard, rows, frequency, n_texts, mean_length, window)), OUT_TYPES)

    return run


def packed(docs: DataFrame, path: str | None = None, window: int = WINDOW, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset): the pieces of all texts of docs (doc_id, text)."""
    path = path or tokenizer_path()
    tokens = stored(tokenized(docs, path), "tokens")
    size = memory(path).size
    frequency, n_texts, n_tokens = document_frequencies(tokens, size)
    sums = tokens.select("ids").mapInArrow(_route_sizes(frequency, window), "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).toPandas()
    sizes = np.zeros(size, np.int64)
    sizes[sums["token"].to_numpy(np.int64)] = sums["n"].to_numpy(np.int64)
    first, split = shard_plan(sizes, shard_tokens)
    pieces = tokens.mapInArrow(_deal(frequency, first, split, window), PIECE)
    dealt = pieces.repartition("shard").sortWithinPartitions("shard", "route", "doc_id", "start", "length")
    return dealt.mapInArrow(_pack(frequency, n_texts, n_tokens / max(1, n_texts), window), OUT)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(documents(spark, sf_dir).select("doc_id", "text"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the packed pieces of all documents that are left."""
    return packed(docs.select("doc_id", "text"))
