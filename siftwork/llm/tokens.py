"""Tokens of whole texts by public tokenizers, pre-token by pre-token, and counts by the whole-token shortcut.

Both encoders rest on the same fact: a tokenizer works on pre-tokens apart from one another, so the ids of a text are
the ids of its pre-tokens joined. Frequent pre-tokens are looked up, the others go to the library together.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_batches, worker_memory

#: Most entries of a worker's look-up table; at this size it starts afresh. It changes speed only.
TABLE_ENTRIES = 600_000
#: Bytes of texts that are cut and looked up together, about; a longer text is taken alone.
TEXT_BYTES = 5_000_000


#: Letters on which all libraries agree, and what may follow them as one pre-token of its own.
_TAIL = '.,;:!?#*$%&|<>()"'
_FORM = re.compile(f"([A-Za-zÀ-ÖØ-öø-ɏ]+)([{_TAIL}]*)")


class ByteBpe:
    """Whole-text ids of a byte-level BPE file of the `tokenizers` library, as little-endian unsigned 32-bit bytes.

    Its pre-tokenizer ends a pre-token before each space that a non-space follows, whatever stands around it, and makes
    a line end between two non-spaces a pre-token of its own. So a text is cut there, and each piece is encoded once by
    the library and then looked up: the joined ids are those of the whole text. Texts that hold a special token's
    string go to the library whole, as it splits them first; texts with other runs of white space are cut before spaces only.

    Texts are cut and their pieces numbered in Arrow, so that Python sees each distinct piece of some texts once.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.library = Tokenizer.from_file(path)
        added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.special = "|".join(map(re.escape, added))
        #: The characters that stand for bytes in the vocabulary.
        self.byte_chars = {b: pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str(bytes([b]).decode("latin1"))[0][0][-1] for b in (*range(128), *range(0xC3, 0xCA))}
        self.byte_chars |= {b: pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str(bytes([0xC3, b]).decode())[0][0][-1] for b in range(0x80, 0xC0)}
        self.byte_chars |= {b: pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str(bytes([b, 0x80]).decode())[0][0][0] for b in range(0xC3, 0xCA)}
        self.tokenize = self.library.model.tokenize
        self.id_bytes = [i.to_bytes(4, "little") for i in range(self.library.get_vocab_size(with_added_tokens=True))]
        #: Ids of letters with a space in front, of tails, and of pieces cut at spaces only.
        self.known: dict[str, bytes] = {}
        self.tails: dict[str, bytes] = {}
        self.others: dict[str, bytes] = {}
        self.line_end = self._encode("\n")

    def _encode(self, text: str) -> bytes:
        return np.array(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4").tobytes()

    def _word(self, letters: str, space: str) -> bytes:
        """Letters, with a space in front or without, are one pre-token, which the library's model can take as it is."""
        text = ("Ġ" if space else "") + letters if letters.isascii() else (space + letters).encode().decode("latin1").translate(self.byte_chars)
        id_bytes = self.id_bytes
        return b"".join([id_bytes[t.id] for t in self.tokenize(text)])

    def _tail(self, tail: str) -> bytes:
        if tail not in self.tails:
            if len(self.tails) > 10_000:
                self.tails.clear()
            self.tails[tail] = self._encode(tail)
        return self.tails[tail]

    def _piece(self, piece: str, space: str) -> bytes:
        form = _FORM.fullmatch(piece)
        if not form:
            return self._encode(space + piece)
        letters, tail = form.groups()
        return self._word(letters, space) + self._tail(tail) if tail else self._word(letters, space)

    def _known(self, piece: str) -> bytes | None:
        """The ids of a piece with a space in front, or of a line end and what follows it; None for irregular white space."""
        ids = self.known.get(piece)
        if ids is None:
            letters = piece.rstrip(_TAIL)
            if form := letters.isascii() and letters.isalpha():  # the form, without its expression
                tail = piece[len(letters) :]
            else:
                if self._irregular(piece):
                    return None
                if piece[0] == "\n":
                    return self.line_end + self._piece(piece[1:], "")
                form = _FORM.fullmatch(piece)
                letters, tail = form.groups() if form else (piece, "")
            ids = self.known.get(letters) if tail else None
            if ids is None:
                if len(self.known) > TABLE_ENTRIES:
                    self.known.clear()
                ids = self.known[letters] = self._word(letters, " ") if form else self._encode(" " + piece)
            if tail:
                ids += self._tail(tail)
        return ids

    @staticmethod
    def _irregular(piece: str) -> bool:
        """White space at its start (but for one line end before a non-space) or at its end, or nothing in it."""
        return not piece or piece[-1].isspace() or piece[0].isspace() and (piece[0] != "\n" or piece[1].isspace())

    def _cut_at_spaces(self, text: str) -> bytes:
        pieces = re.split(r" (?=\S)", text)
        if len(self.others) > TABLE_ENTRIES // 4:
            self.others.clear()
        others = self.others
        for p in set(pieces[1:]).difference(others):
            others[p] = self._encode(" " + p)
        return (self._encode(pieces[0]) if pieces[0] else b"") + b"".join([others[p] for p in pieces[1:]])

    def encode_all(self, texts: pa.Array | list[str | None], at_once: int = TEXT_BYTES) -> Iterator[bytes]:
        """The ids of each text; of none for null. About at_once bytes of texts are cut and looked up together."""
        texts = pa.array(texts, pa.large_string()) if isinstance(texts, list) else texts.cast(pa.large_string())
        sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
        lo = 0
        while lo < len(texts):  # some texts at a time, or one of any length
            hi = max(lo + 1, int(np.searchsorted(sizes, (sizes[lo - 1] if lo else 0) + at_once)))
            yield from self._encode_some(texts.slice(lo, hi - lo))
            lo = hi

    def _encode_some(self, texts: pa.Array) -> list[bytes]:
        whole = np.zeros(len(texts), bool)
        if self.special:
            whole = pc.fill_null(pc.match_substring_regex(texts, self.special), False).to_numpy(zero_copy_only=False)
        cut = pc.split_pattern(pc.replace_substring(pc.fill_null(texts, ""), "\n", " \n"), " ")
        coded = cut.flatten().dictionary_encode()
        pieces, which = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        known = self._known
        ids = [x or known(p) for x, p in zip(map(self.known.get, pieces), pieces)]
        bad = np.fromiter([x is None for x in ids], bool, len(ids))
        data = np.frombuffer(b"".join([x or b"" for x in ids]), "<u4")
        lengths = np.fromiter([len(x) // 4 if x else 0 for x in ids], np.int64, len(ids))
        starts = np.cumsum(lengths) - lengths
        edges = cut.offsets.to_numpy()
        edges = edges - edges[0]
        head = edges[:-1]  # each text's first piece has no space in front
        lengths_at = lengths[which]
        lengths_at[head] = 0
        ends = np.cumsum(lengths_at)
        joined = b""
        if len(ends):  # the place in data of each id; 32 bits take half the memory
            kind = np.int32 if max(ends[-1], len(data)) < 1 << 31 else np.int64
            at = np.repeat((starts[which] - (ends - lengths_at)).astype(kind), lengths_at)
            at += np.arange(len(at), dtype=kind)
            joined = data.take(at).tobytes()
        upto = np.append(0, ends)[edges] * 4
        odd = np.logical_or.reduceat(bad[which], head) if len(head) else whole
        empty = pc.equal(pc.fill_null(pc.binary_length(texts), 0), 0).to_numpy(zero_copy_only=False)
        out = []
        for k, (first, a, b) in enumerate(zip(which[head].tolist(), upto[:-1].tolist(), upto[1:].tolist(), strict=True)):
            if empty[k]:
                out.append(b"")
            elif whole[k]:
                out.append(self._encode(texts[k].as_py()))
            elif odd[k]:
                out.append(self._cut_at_spaces(texts[k].as_py()))
            else:
                out.append(self._piece(pieces[first], "") + joined[a:b])
        return out


class PieceCounts:
    """Token counts of a sentencepiece BPE model by the whole-token shortcut.

    Proved once from the model: (a) no piece holds the word mark after another character, so no merge crosses the
    place where a run of spaces starts, and a text may be cut there; (b) which vocabulary strings the library encodes
    alone as one token. A pre-token that is such a string counts one directly. All others are merged by the library,
    each distinct one once. Texts that hold the word mark itself, or NUL, go to the library whole.
    """

    MARK = "▁"

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        ordinary = [p for i, p in enumerate(pieces) if not (self.model.is_control(i) or self.model.is_unknown(i) or self.model.is_unused(i) or self.model.is_byte(i))]
        crossing = re.compile(f"[^{self.MARK}]{self.MARK}")
        assert not any(crossing.search(p) for p in ordinary), "a piece crosses a word's start"
        probe = ["a", "b c", "  d", "e  f ", "g\nh", "é　i"]
        assert all(self._whole(t) == sum(map(self._alone, self.cut(t))) for t in probe), "the model does not add its mark in front and keep spaces as they are"
        #: The proved strings, without the space they start with.
        self.one = {p[1:] for p in ordinary if p.startswith(self.MARK) and len(p) > 1 and self._whole(p[1:].replace(self.MARK, " ")) == 1}
        self.known = dict.fromkeys(self.one, 1)

    @staticmethod
    def cut(text: str) -> list[str]:
        """The pre-tokens: each a run of spaces with what follows; the model puts one space in front of the text."""
        return re.findall(r" +[^ ]*", " " + text) if text else []

    def _whole(self, text: str) -> int:
        return len(self.model.encode(text, num_threads=1)) if text else 0

    def _alone(self, pre_token: str) -> int:
        return self._whole(pre_token[1:]) if len(pre_token) > 1 else self._one_space()

    def _one_space(self) -> int:
        return len(self.model.encode("a ")) - len(self.model.encode("a"))

    def count_all(self, texts: list[str | None]) -> list[int]:
        cut, new = [], set()
        for text in texts:
            if not text:
                cut.append(0)
            elif self.MARK in text or "\0" in text:
                cut.append(self._whole(text))
            else:
                pieces = text.split(" ")
                if "" in pieces:  # runs of spaces: a pre-token holds all of its run
                    pieces = [p[1:] for p in self.cut(text)]
                new.update(set(pieces).difference(self.known))
                cut.append(pieces)
        if len(self.known) + len(new) > TABLE_ENTRIES:
            new = {p for pieces in cut if isinstance(pieces, list) for p in pieces} - self.one
            self.known = dict.fromkeys(self.one, 1)
        if "" in new:
            self.known[""] = self._alone(" ")
        todo = sorted(new - {""})
        for lo in range(0, len(todo), 20_000):
            some = todo[lo : lo + 20_000]
            self.known.update(zip(some, map(len, self.model.encode(some, num_threads=1)), strict=True))
        get = self.known.__getitem__
        return [x if isinstance(x, int) else sum(map(get, x)) for x in cut]


_loaded: dict[tuple[type, str], object] = {}


def loaded(kind: type, path: str):
    """One encoder a worker process."""
    worker_memory("tokens", _loaded.clear)
    if (kind, path) not in _loaded:
        _loaded[kind, path] = kind(path)
    return _loaded[kind, path]


def count_tokens(docs: DataFrame, path: str, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every whole text.

    A null or empty text has 0 bytes and 0 tokens; a null doc_id stays null; repeated rows are counted each; an empty
    table gives no rows; other columns are ignored. A text of any length is counted whole.
    """

    text_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = loaded(PieceCounts, path)
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(counts.count_all(part.column(2).to_pylist()), pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    rows = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")
    counted = rows.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def op5_whole_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
