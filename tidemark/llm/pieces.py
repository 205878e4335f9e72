"""SentencePiece BPE encoding by last tokens of prefixes.

For a merge-based tokenizer the encoding of a text ends, for every prefix, in
one token that depends on the prefix alone.  ``PrefixEncoder`` fills the table
of those last tokens from left to right: an automaton over the vocabulary
yields every token that ends at a position, and a candidate is right if it may
stand behind the last token of the prefix before it.  Two tokens may stand
side by side if merging their joint text gives back just these two; the
verdict is remembered per pair.  The ids are then read off backwards.

No token crosses from another character to U+2581 or, in most models, from the
end of a word to punctuation, so texts are cut there and the cut pieces are
encoded once each and remembered (a bounded table of two generations).
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator
from itertools import groupby
from math import inf

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import on_workers, rows_of, table

SPACE = "▁"
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class PrefixEncoder:
    """Encodes as the sentencepiece library does with a BPE model without sampling.

    Covers models whose normalizer only turns spaces into U+2581 and puts one
    in front, and whose unknown characters fall back to bytes; any other model
    is refused when it is loaded.
    """

    def __init__(self, path: str, remembered: int = 400_000):
        import ahocorasick
        import sentencepiece

        sp = self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        for probe in ("a  b ", "ﬁ① Å", " x\n\ty"):
            if sp.normalize(probe) != SPACE + probe.replace(" ", SPACE):
                raise ValueError("the model's normalizer changes more than spaces")
        n = sp.get_piece_size()
        plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
        self.byte_ids = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        if not all(map(sp.is_byte, self.byte_ids)):
            raise ValueError("the model has no byte fallback")
        self.ids = {sp.id_to_piece(i): i for i in plain}
        self.score = {p: sp.get_score(i) for p, i in self.ids.items()}
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("a token of the model holds a space inside")
        self.bos, self.eos = sp.bos_id(), sp.eos_id()
        self.text = {i: p for p, i in self.ids.items()}
        self.automaton = ahocorasick.Automaton()
        parts: dict[str, tuple[str, str]] = {}  # the two that a token was merged from
        for p, i in self.ids.items():
            if len(p) == 1 or self._merge(p, parts) == [p]:  # others never come out of merging
                self.automaton.add_word(p, (len(p), i))
        self.right = {i: self._spine(p, parts, 1) for p, i in self.ids.items()}
        self.left = {i: self._spine(p, parts, 0) for p, i in self.ids.items()}
        self.automaton.make_automaton()
        self.joins = {p[k : k + 2] for p in self.ids for k in range(len(p) - 1)}
        self.letters = {p for p in self.ids if len(p) == 1}
        if any(not self.letters.issuperset(p) for p in self.ids):
            raise ValueError("a token of the model has a character that is no token")
        self.fits: dict[int, bool] = {}
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.remembered = remembered
        latin = "A-Za-zÀ-ÖØ-öø-ɏ"
        if any(re.search(rf"[{latin}][^{latin}]|[\n\t]", p) for p in self.ids):
            self.chunks = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+").findall
        else:  # no token goes on from a Latin letter to anything else, nor holds a line break or tab
            rest = rf"[^{latin}{SPACE}\n\t]"
            self.chunks = re.compile(rf"[\n\t]|{SPACE}+{rest}*[{latin}]*|{rest}+[{latin}]*|[{latin}]+").findall

    def _merge(self, text: str, last: dict[str, tuple[str, str]]) -> list[str]:
        """Merges by definition: the best-scored joint piece first, the leftmost of equals.

        If one piece comes out, ``last`` gets the two that it was made of.
        """
        parts, score = list(text), self.score
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                s = score.get(parts[k] + parts[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if at < 0:
                break
            if len(parts) == 2:
                last[text] = parts[0], parts[1]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _spine(self, piece: str, parts: dict, side: int) -> list[tuple[str, float, float]]:
        """The pieces that stand at one edge of a token while it grows: text, score when made, score when merged on."""
        out, after = [], -inf
        while True:
            made = self.score[piece] if piece in parts else inf
            out.append((piece, made, after))
            if piece not in parts:
                return out
            piece, after = parts[piece][side], made

    def _fit(self, a: int, b: int) -> bool:
        """Whether token ``b`` may follow token ``a``: no piece at the end of ``a`` would have merged with one at the start of ``b``.

        Merges go by falling score, so a piece is there from its own score
        down to that of the merge that takes it; among equals the left goes
        first.
        """
        x, y = self.text[a], self.text[b]
        fit = True
        if x[-1] + y[0] in self.joins:
            get = self.score.get
            for p, made_p, after_p in self.right[a]:
                for q, made_q, after_q in self.left[b]:
                    s = get(p + q)
                    if s is not None and s > after_p and s >= after_q and made_p >= after_q and made_q > after_p:
                        fit = False
        if len(self.fits) > 1_500_000:
            self.fits.clear()
        self.fits[a << 32 | b] = fit
        return fit

    def _piece(self, s: str) -> bytes:
        """Ids of one piece of known characters as bytes, by the table of last tokens."""
        last = [-1] * len(s)  # the last token of the prefix that ends with this character
        size, fits = last.copy(), self.fits
        for end, (length, token) in self.automaton.iter(s):
            if last[end] < 0:
                before = end - length
                if before < 0:
                    last[end], size[end] = token, length
                elif (a := last[before]) >= 0:
                    if (fit := fits.get(a << 32 | token)) is None:
                        fit = self._fit(a, token)
                    if fit:
                        last[end], size[end] = token, length
        out, at = [], len(s) - 1
        while at >= 0:
            out.append(last[at])
            at -= size[at]
        out.reverse()
        return array("I", out).tobytes()

    def _chunk(self, s: str) -> bytes:
        """Characters that are no token of their own become bytes and part what is around them."""
        if self.letters.issuperset(s):
            return self._piece(s)
        out = []
        for known, run in groupby(s, self.letters.__contains__):
            if known:
                out.append(self._piece("".join(run)))
            else:
                out += (array("I", [self.byte_ids[b] for b in c.encode()]).tobytes() for c in run)
        return b"".join(out)

    def _get(self, s: str) -> bytes:
        got = self.young.get(s)
        if got is None:
            got = self.old.get(s)
            if got is None:
                got = self._chunk(s)
            if len(s) <= 64:
                if len(self.young) >= self.remembered:
                    self.old, self.young = self.young, {}
                self.young[s] = got
        return got

    def encode(self, text: str) -> bytes:
        """Ids with begin and end, as native unsigned 32-bit integers."""
        edge = array("I", [self.bos]).tobytes(), array("I", [self.eos]).tobytes()
        if not text:
            return edge[0] + edge[1]
        get = self._get
        body = [get(c) for c in self.chunks(SPACE + text.replace(" ", SPACE))]
        return b"".join([edge[0], *body, edge[1]])

    def decode(self, ids: bytes) -> str:
        return self.sp.decode(array("I", ids).tolist())


_ENCODERS: dict[str, PrefixEncoder] = {}


def encoder(path: str) -> PrefixEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = PrefixEncoder(path)
    return _ENCODERS[path]


def encode_documents(docs: DataFrame, model: str | None = None, keep: bool = False) -> DataFrame:
    """One row per row of ``docs``: token count and digests of ids and decoded text.

    Null texts count as empty (two ids, decoded ""); very long ones are encoded
    whole, a chunk at a time; of two merges that tie the library's order holds;
    repeated rows give repeated rows; extra columns are ignored; an empty table
    gives no rows.
    ``keep`` adds ``ids array<int>`` and ``decoded``.
    """
    model = model or default_model()
    on_workers(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(model)
        for ids, texts in rows_of(batches, "doc_id", "text"):
            cols: list[list] = [[] for _ in range(6)]
            for t in texts:
                b = enc.encode(t or "")
                d = enc.decode(b)
                cols[1].append(len(b) // 4)
                cols[2].append(hashlib.sha256(b).hexdigest())
                cols[3].append(hashlib.sha256(d.encode()).hexdigest())
                if keep:
                    cols[4].append(array("I", b).tolist())
                    cols[5].append(d)
            arrays = [pa.array(ids, pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep:
                arrays += [pa.array(cols[4], pa.list_(pa.int32())), pa.array(cols[5], pa.string())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(arrays, names)

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA + (", ids array<int>, decoded string" if keep else ""))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents``; edge cases as in ``encode_documents``."""
    return encode_documents(table(spark, sf_dir, "documents"))
