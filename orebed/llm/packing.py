"""Packing: token pieces into sequences by first-fit decreasing over a tournament tree.

Pieces go to randomised groups by a hash, each group is packed on its own, so the work of a task
does not grow with the corpus.  In a group the pieces come in falling length and each goes to the
first bin with room; a tournament tree over the bins' free room finds that bin in log(n) steps.
"""

from __future__ import annotations

import json
import re
import sys
import types
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import buckets, free_name, ready, staged, unsigned_hash

CAPACITY = 4096
END_ID = 2
#: Pieces of a randomised group, on average.
GROUP_ROWS = 2048
#: Pieces kept in a worker's dictionary, and the longest of them in bytes.
CACHE_PIECES, CACHE_BYTES = 1_000_000, 64
#: New pieces encoded in one call.
TOGETHER = 100
VOCABULARY = "word_bpe_49k.json"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: The tokenizer's own cut of lower-cased text, on bytes; bytes beyond ASCII count as letters here.
PIECE = re.compile(rb"'(?:s|t|re|ve|m|ll|d)|[a-z\x80-\xff]+|[0-9]|[^\x20\x09-\x0Da-z0-9\x80-\xff]+")


BARE = {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}
CONTROL = re.compile(rb"[\x00-\x1f\x7f]")


class Encoder:
    """Texts to ids, as little-endian unsigned 32-bit integers, with a dictionary of pieces.

    The tokenizer lowers the text, drops white space and encodes runs of letters, digits and runs of marks
    each for itself, so a text's ids are the ids of its pieces, one after the other.  A run with bytes beyond
    ASCII is a piece only if it is letters that stay letters under composition and lower-casing; a text with
    any other such run, or with the beginning of a special token, is encoded word by word instead, as no token,
    composition or special token spans white space.  New pieces are encoded many at a time, separated by
    blanks: every piece ends with the one token of it that the vocabulary marks as a word's end.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        tool = Tokenizer.from_file(path)
        self.encode = tool.encode
        # the same model without the normaliser and the cut, which leave lower-cased ASCII pieces as they are
        bare = json.loads(tool.to_str()) | {"normalizer": None, "added_tokens": [], "pre_tokenizer": BARE}
        self.encode_ascii = Tokenizer.from_str(json.dumps(bare)).encode
        vocabulary = tool.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.known: dict[bytes, bytes | None] = {}

    def ids(self, text: bytes) -> bytes:
        return np.array(self.encode(text.decode(), add_special_tokens=False).ids, "<u4").tobytes()

    def learn(self, pieces: list[bytes]) -> dict[bytes, bytes | None]:
        """The ids of new pieces; None for those that are no pieces."""
        got: dict[bytes, bytes | None] = {}
        plain, wide = [p for p in pieces if p.isalnum()], []
        for piece in (p for p in pieces if not p.isalnum()):
            if piece.isascii():
                if CONTROL.search(piece):
                    got[piece] = self.ids(piece)
                else:
                    plain.append(piece)
            elif (letters := piece.decode()).isalpha() and (whole := unicodedata.normalize("NFC", letters)).isalpha() and whole.lower().isalpha():
                wide.append(piece)
            else:
                got[piece] = None
        for encode, own in ((self.encode_ascii, plain), (self.encode, wide)):
            for at in range(0, len(own), TOGETHER):
                part = own[at : at + TOGETHER]
                ids = np.array(encode(b" ".join(part).decode(), add_special_tokens=False).ids, "<u4")
                cuts = (np.flatnonzero(self.ends[ids]) + 1) * 4
                if len(cuts) == len(part) and (not len(cuts) or cuts[-1] == 4 * len(ids)):
                    data, start = ids.tobytes(), 0
                    for piece, end in zip(part, cuts.tolist(), strict=True):
                        got[piece] = data[start:end]
                        start = end
                else:
                    got |= {piece: self.ids(piece) for piece in part}
        return got

    def texts(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text."""
        cuts = [None if b"<|" in t else PIECE.findall(t.lower()) for t in texts]
        if len(self.known) > CACHE_PIECES:
            self.known.clear()
        known = self.known
        new = list(set().union(*filter(None, cuts)).difference(known))
        known.update(self.learn(new))
        get, out = known.__getitem__, []
        for text, pieces in zip(texts, cuts, strict=True):
            try:
                out.append(b"".join(map(get, pieces)))
            except TypeError:  # no pieces, or something that is no piece
                out.append(b"".join(map(self.ids, text.split())))
        for piece in [p for p in new if len(p) > CACHE_BYTES]:
            del known[piece]
        return out


def encoder(path: str) -> Encoder:
    """The worker process's encoder: later tasks of the process find the pieces of earlier ones."""
    held = sys.modules.setdefault("orebed_encoder", types.ModuleType("orebed_encoder")).__dict__
    if path not in held:
        held[path] = Encoder(path)
    return held[path]


def cut(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """One row for each piece: doc_id, start, length, doc_tokens, ids (little-endian uint32 bytes).

    A document is its ids and then id 2, cut at multiples of ``capacity``.  Null and empty texts are
    the single id 2.  Ids of documents may be null or repeat; each row is a document of its own.
    """
    path, step = path or vocabulary_path(), 4 * capacity
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        end = END_ID.to_bytes(4, "little")
        for batch in batches:
            at, start, length, total, ids = [], [], [], [], []
            texts = [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
            for i, coded in enumerate(encoder(path).texts(texts)):
                coded += end
                for s in range(0, len(coded), step):
                    piece = coded[s : s + step]
                    at.append(i)
                    start.append(s // 4)
                    length.append(len(piece) // 4)
                    total.append(len(coded) // 4)
                    ids.append(piece)
            ids_of = batch.column(0).take(pa.array(at, pa.int32()))
            columns = [ids_of, *(pa.array(x, pa.int64()) for x in (start, length, total)), pa.array(ids, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "length", "doc_tokens", "ids"])

    ready(docs.sparkSession)
    wanted = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return wanted.mapInArrow(run, f"doc_id {kind}, start long, length long, doc_tokens long, ids binary")


def first_fit(lengths: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """Bin and offset of each length, which come in falling order, by a tournament tree."""
    size = 1
    while size < len(lengths):
        size *= 2
    room = [capacity] * (2 * size)  # room[1] is the root; the leaves are the bins
    bins, offsets = [], []
    for n in lengths:
        if not 0 < n <= capacity:
            raise ValueError(f"a piece of {n} does not fit {capacity}")
        k = 1
        while k < size:
            k *= 2
            if room[k] < n:
                k += 1
        bins.append(k - size)
        offsets.append(capacity - room[k])
        room[k] -= n
        while k > 1:
            k //= 2
            left, right = room[2 * k], room[2 * k + 1]
            best = left if left >= right else right
            if room[k] == best:
                break
            room[k] = best
    return bins, offsets


def place(pieces: DataFrame, capacity: int = CAPACITY, group_rows: int = GROUP_ROWS, seed: int = 0) -> DataFrame:
    """``pieces`` (doc_id, start, length and any others) with sequence_id and offset.

    Offsets of a sequence run without a gap from 0.  Ties of length go by doc_id, start and the rest
    of the row; rows that are equal in all columns are interchangeable.  Columns of the input named
    sequence_id or offset are replaced.  Equal rows, however many, go to groups of their own draw.  An empty table returns no rows.
    """
    spark = ready(pieces.sparkSession)
    pieces = staged(pieces.drop("sequence_id", "offset"), "pieces")
    groups = buckets(pieces.count(), group_rows)
    group = free_name(pieces, "pack_group")
    plain = [f.name for f in pieces.schema if isinstance(f.dataType, T.AtomicType)]
    dealt = pieces.withColumn(group, F.pmod(unsigned_hash(F.lit(seed), F.monotonically_increasing_id(), *[F.col(f"`{c}`") for c in plain]), F.lit(groups)))

    def pack(rows: pa.Table) -> pa.Table:
        keys = [("length", "descending"), *((c, "ascending") for c in plain if c != "length")]
        rows = rows.sort_by(keys)
        bins, offsets = first_fit(rows.column("length").to_pylist(), capacity)
        base = rows.column(group)[0].as_py() << 32
        rows = rows.drop_columns([group])
        rows = rows.append_column("sequence_id", pa.array([base + b for b in bins], pa.int64()))
        return rows.append_column("offset", pa.array(offsets, pa.int64()))

    schema = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), buckets(groups, 64))
    return dealt.repartition(parts, group).groupBy(group).applyInArrow(pack, schema)
