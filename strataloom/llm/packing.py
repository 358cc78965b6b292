"""Sum-of-squares online packing of tokenised documents into fixed windows.

Documents longer than the window give full windows and one rest. A packer takes
the rests one by one and puts each at the fill level h that minimises the sum
over levels of N(level) ** 2, N counting the partially filled windows: moving a
window from h to h + s changes that sum by 2 * (N(h + s) - N(h)) + 2, so one
vector expression over the level array finds the place. Windows are closed when
full; rows are emitted as they are placed, so a packer holds the level array
and one id for each open window, never the documents.

Tokenising is a map over the documents. Only (id, position, length, checksum)
rows are dealt out, by hash, to packers of about `per_packer` rests each, so
that the windows left open are few against those filled, at any input size.
"""

from __future__ import annotations

import json
import re
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.llm.common import Memo, small_batches, stored, table

WINDOW = 4096
END_ID = 2
PER_PACKER = 30_000


def _byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level BPE vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def _letters(kind: str) -> str:
    """The characters below U+0250 of a general category, for a character class."""
    return "".join(re.escape(chr(i)) for i in range(0x250) if unicodedata.category(chr(i))[0] == kind)


class WordBpe:
    """Ids of a lower-casing word-end BPE file, equal to tokenizers.Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids.

    Texts of Latin letters (below U+0250, where NFC changes nothing and lower
    case is one letter for one) are cut into pieces here, and each distinct
    piece is encoded once: by the file's merges, run as ranks, where the end of
    a word is a byte that UTF-8 never uses. Merging by rank of the result and
    merging by rank of the pair agree where every token's own bytes merge into
    it, as they do here; the tests hold both against each other. All other
    texts, and those that hold the string of a special token, which the file
    reads as that token, go to the tokenizers library as they are.
    """

    L, N = _letters("L"), _letters("N")
    LATIN = re.compile(rf"'(?:s|t|re|ve|m|ll|d)|[{L}]+|[{N}]|[^\s{L}{N}]+")
    ASCII = re.compile(r"'(?:s|t|re|ve|m|ll|d)|[a-z]+|[0-9]|[^\sa-z0-9]+")
    #: white space to str alone, and letters that NFC or lower case changes in length
    ODD = ("\x1c", "\x1d", "\x1e", "\x1f", "İ", "ŉ", "ǰ")

    def __init__(self, path: str, limit: int = 400_000):
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model = file["model"]
        self.special = tuple(t["content"] for t in file["added_tokens"])
        vocab, letter = model["vocab"], _byte_letters()
        back = {c: b for b, c in letter.items()}
        suffix = model["end_of_word_suffix"]

        def raw(token: str) -> bytes:
            end = token.endswith(suffix)
            return bytes(back[c] for c in (token[: -len(suffix)] if end else token)) + b"\xff" * end

        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        ranks = {bytes([b]) + b"\xff": b for b in range(255)}
        ids = dict.fromkeys(range(1024), -1)
        ids |= {b: vocab[letter[b] + suffix] for b in range(255)}
        ranks |= {bytes([b]): 256 + b for b in range(256)}
        ids |= {256 + b: vocab[letter[b]] for b in range(255)}
        for i, (a, b) in enumerate(pairs):
            ranks.setdefault(raw(a + b), 1024 + i)
            ids[1024 + i] = vocab[a + b]
        core = tiktoken.Encoding("words", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._core_bpe
        numbers = np.array([ids.get(i, -1) for i in range(1024 + len(pairs))], "<i4")
        self.pieces = Memo(lambda piece: numbers[core.encode_single_piece(piece.encode() + b"\xff")].tobytes(), limit)

    def encode(self, text: str) -> bytes:
        """The ids of a text, little-endian 32-bit."""
        ascii = text.isascii()
        latin = ascii or np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").max() <= 0x24F
        if not latin or any(c in text for c in self.ODD) or any(c in text for c in self.special):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return b"".join(map(self.pieces.__getitem__, (self.ASCII if ascii else self.LATIN).findall(text.lower())))


_READY: dict[str, WordBpe] = {}


def word_bpe(path: str) -> WordBpe:
    """One for each worker process and file: workers serve many tasks."""
    if path not in _READY:
        _READY[path] = WordBpe(path)
    return _READY[path]


class Packer:
    """Sum-of-squares placement into windows of `size`."""

    def __init__(self, size: int = WINDOW):
        self.size, self.n = size, np.zeros(size + 1, np.int64)
        self.open: list[list[int]] = [[] for _ in range(size + 1)]
        self.made = 0

    def place(self, s: int) -> tuple[int, int]:
        """(window, offset) for a piece of s tokens, 1 to size. Ties go to the fullest window."""
        size, n = self.size, self.n
        if s == size:
            self.made += 1
            return self.made - 1, 0
        delta = 2 * (n[s:] - n[: size - s + 1]) + 2
        delta[-1] = 1 - 2 * n[size - s]  # the window closes
        delta[0] = 2 * n[s] + 1  # a new window
        free = n[: size - s + 1] > 0
        free[0] = True
        delta[~free] = np.iinfo(np.int64).max
        h = len(delta) - 1 - int(np.argmin(delta[::-1]))
        if h:
            window = self.open[h].pop()
            n[h] -= 1
        else:
            window = self.made
            self.made += 1
        if h + s < size:
            n[h + s] += 1
            self.open[h + s].append(window)
        return window, h


def token_pieces(docs: DataFrame, path: str, size: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """One row for each piece of at most `size` ids of each row of docs.

    A null or empty text gives the end id alone. Texts of any length are
    encoded whole and cut afterwards; repeated rows give their pieces each;
    null ids stay null. Columns other than doc_id and text are not read. No
    rows give none.
    """
    small_batches(docs.sparkSession)
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
    end = int(end_id).to_bytes(4, "little")

    def run(batches):
        bpe = word_bpe(path)
        for b in batches:
            rows = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids = bpe.encode(text or "") + end
                for at in range(0, len(ids), 4 * size):
                    cut = ids[at : at + 4 * size]
                    rows.append((doc, at // 4, len(cut) // 4, zlib.crc32(cut), len(ids) // 4))
            cols = list(zip(*rows)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def pack(pieces: DataFrame, size: int = WINDOW, per_packer: int = PER_PACKER) -> DataFrame:
    """pieces with sequence_id and offset.

    Full pieces have a sequence of their own; repeated rows are packed each,
    and equal costs go to the fullest window. No pieces give no rows.
    """
    rests = pieces.where(F.col("length") < size).count()
    packers = max(1, -(-rests // per_packer))
    dealt = pieces.repartition(packers, F.xxhash64("doc_id", "start", "ids_crc32"), F.pmod(F.monotonically_increasing_id(), F.lit(1024)))
    dealt = dealt.sortWithinPartitions(F.xxhash64("doc_id", "start", "ids_crc32"), "doc_id", "start", "ids_crc32")  # a task that runs again places alike
    names = dealt.columns

    def run(batches):
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 40
        packer = Packer(size)
        at = names.index("length")
        for b in batches:
            placed = [packer.place(s) for s in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array([base + w for w, _ in placed], pa.int64()), pa.array([o for _, o in placed], pa.int64())], [*names, "sequence_id", "offset"]
            )

    schema = ", ".join(f"{c} {t}" for c, t in dealt.dtypes) + ", sequence_id long, offset long"
    return dealt.mapInArrow(run, schema)


def pack_documents(docs: DataFrame, path: str, size: int = WINDOW, per_packer: int = PER_PACKER) -> DataFrame:
    """The pieces of token_pieces, packed: see there and `pack` for nulls, empty and long texts, repeated rows and empty tables."""
    pieces = stored(token_pieces(docs, path, size), "pieces")
    return pack(pieces, size, per_packer)


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each piece of each document: see pack_documents."""
    return pack_documents(table(spark, sf_dir, "documents"), vocabulary())
