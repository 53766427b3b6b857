"""SentencePiece BPE encoding by a prefix table, and decoding.

A BPE tokenisation is fixed by its adjacent pairs: tokens t1..tn are the
encoding of their concatenation exactly if every piece encodes to itself and
every adjacent pair (a, b) encodes to [a, b].  So each prefix of a text has one
last token: the dictionary piece ending there whose predecessor, the last token
of the prefix before it, is compatible with it.  An Aho-Corasick automaton
gives the pieces that end at each position; pair tests are remembered.  Ids are
recovered backwards from the table.  Time is linear in the text whatever its
shape.

Pieces hold the space mark only at their start, and characters without a piece
fall back to bytes and never merge, so a text is cut at both kinds of border
and the results for recurring segments are kept in a bounded memo.
"""

from __future__ import annotations

import re
from array import array
from functools import lru_cache

import ahocorasick
import numpy as np

SPACE = "▁"
MEMO_SEGMENTS = 400_000
PAIR_MEMO = 1_000_000
#: Marks of the quick cut; texts that hold them are cut the slower way.
LINE, AFTER_LINE = "\x01", "\x02"


class _Memo(dict):
    """segment -> ids as bytes; emptied when full, so that its size is bounded."""

    def __init__(self, fill, most: int):
        self.fill, self.most = fill, most

    def __missing__(self, key):
        value = self.fill(key)
        if len(key) <= 256:
            if len(self) >= self.most:
                self.clear()
            self[key] = value
        return value


class PrefixTableBpe:
    """Encoder and decoder for a SentencePiece BPE model with byte fallback and identity normalisation."""

    def __init__(self, model_path: str, memo_segments: int = MEMO_SEGMENTS):
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(model_path, "rb") as f:
            model.ParseFromString(f.read())
        kinds = pb.ModelProto.SentencePiece
        if model.trainer_spec.model_type != pb.TrainerSpec.BPE or not model.trainer_spec.byte_fallback or model.normalizer_spec.precompiled_charsmap or model.normalizer_spec.remove_extra_whitespaces or not model.normalizer_spec.add_dummy_prefix:
            raise ValueError("not a byte-fallback BPE model with identity normalisation and a dummy prefix")
        self.bos, self.eos, self.unk = model.trainer_spec.bos_id, model.trainer_spec.eos_id, model.trainer_spec.unk_id
        self.score: dict[str, float] = {}
        self.id: dict[str, int] = {}
        self.text: list[str] = []
        self.byte_id = [0] * 256
        surface, self.kind = [], np.zeros(len(model.pieces), np.uint8)
        for i, p in enumerate(model.pieces):
            self.text.append(p.piece)
            if p.type == kinds.BYTE:
                value = int(p.piece[1:-1], 16)
                self.byte_id[value] = i
                surface.append(bytes([value]))
                self.kind[i] = 1
            elif p.type == kinds.NORMAL:
                if SPACE in p.piece.lstrip(SPACE):
                    raise ValueError("a piece crosses words")
                self.id[p.piece], self.score[p.piece] = i, p.score
                surface.append(p.piece.replace(SPACE, " ").encode())
            elif p.type == kinds.CONTROL:
                surface.append(b"")
                self.kind[i] = 2
            elif p.type == kinds.UNKNOWN:
                surface.append(model.trainer_spec.unk_surface.encode())
                self.kind[i] = 3
            else:
                raise ValueError(f"piece type {p.type} is not supported")
        self.surface = surface
        self.automaton = ahocorasick.Automaton()
        for piece, i in self.id.items():
            self.automaton.add_word(piece, (len(piece), i))
        self.automaton.make_automaton()
        self.chars = {c for c in self.id if len(c) == 1}
        #: Neighbouring characters inside pieces; between others nothing merges.
        self.inner = {c[k : k + 2] for c in self.id for k in range(len(c) - 1)}
        self._whole: dict[int, bool] = {}
        self._pair: dict[int, bool] = {}
        self.memo = _Memo(self._encode_word, memo_segments)
        self.segment_memo = _Memo(self._encode_segment, memo_segments // 10)
        self.segments = re.compile(f"\n|{SPACE}*[^{SPACE}\n]+|{SPACE}+").findall

    def _merge(self, text: str) -> list[str]:
        """Plain BPE of a short string: best score first, leftmost on ties."""
        parts = list(text)
        score = self.score
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _is_whole(self, i: int) -> bool:
        known = self._whole.get(i)
        if known is None:
            known = self._whole[i] = self._merge(self.text[i]) == [self.text[i]]
        return known

    def _fits(self, a: int, b: int) -> bool:
        key = a << 20 | b
        known = self._pair.get(key)
        if known is None:
            if len(self._pair) >= PAIR_MEMO:
                self._pair.clear()
            left, right = self.text[a], self.text[b]
            known = self._pair[key] = self._is_whole(b) and self._merge(left + right) == [left, right]
        return known

    def _encode_known(self, text: str) -> list[int]:
        """Ids of a text whose characters are all pieces."""
        last = [-1] * len(text)
        pair = self._pair
        for end, (n, i) in self.automaton.iter(text):
            if last[end] >= 0:
                continue
            start = end - n
            if start < 0:
                if self._is_whole(i):
                    last[end] = i
            else:
                before = last[start]
                known = pair.get(before << 20 | i)
                if known or known is None and self._fits(before, i):
                    last[end] = i
        ids, end, text_of = [], len(text) - 1, self.text
        while end >= 0:
            i = last[end]
            ids.append(i)
            end -= len(text_of[i])
        ids.reverse()
        return ids

    def _encode_segment(self, segment: str) -> bytes:
        chars = self.chars
        if chars.issuperset(segment):
            return array("I", self._encode_known(segment)).tobytes()
        ids: list[int] = []
        run = 0
        for at, c in enumerate(segment):
            if c not in chars:
                if run < at:
                    ids += self._encode_known(segment[run:at])
                ids += [self.byte_id[b] for b in c.encode()]
                run = at + 1
        if run < len(segment):
            ids += self._encode_known(segment[run:])
        return array("I", ids).tobytes()

    def _encode_word(self, word: str) -> bytes:
        """A word of the quick cut: a line end, text right after one, or text after a space."""
        if word == LINE:
            return self._encode_segment("\n")
        if len(word) > 2 and word[-1] in self.chars and word[-2:] not in self.inner:
            return self.memo[word[:-1]] + self.memo[AFTER_LINE + word[-1]]
        return self._encode_segment(word[1:] if word[:1] == AFTER_LINE else SPACE + word)

    def encode_bytes(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers, without begin and end."""
        if not text:
            return b""
        if "  " in text or text[0] == " " or SPACE in text or LINE in text or AFTER_LINE in text:
            return b"".join(map(self.segment_memo.__getitem__, self.segments(SPACE + text.replace(" ", SPACE))))
        return b"".join(map(self.memo.__getitem__, text.replace("\n", f" {LINE} {AFTER_LINE}").split(" ")))

    def encode(self, text: str, ends: bool = True) -> list[int]:
        ids = np.frombuffer(self.encode_bytes(text), "<u4").tolist()
        return [self.bos, *ids, self.eos] if ends else ids

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        """UTF-8 text of ids: control ids vanish, the first space goes, bytes that are no UTF-8 become U+FFFD."""
        if not len(ids):
            return b""
        kind = self.kind[ids]
        keep = ids[kind != 2]
        if not len(keep):
            return b""
        raw = b"".join(map(self.surface.__getitem__, keep.tolist()))
        if (kind == 1).any():
            try:
                raw.decode()
                plain = not (kind[1:-1] == 2).any()
            except UnicodeDecodeError:
                plain = False
            if not plain:
                raw = self._decode_slow(ids)
        if self.text[keep[0]].startswith(SPACE):
            raw = raw[1:]
        return raw

    def _decode_slow(self, ids: np.ndarray) -> bytes:
        """Runs of byte pieces are decoded on their own, and a control id ends a run; each byte that is not part of a character gives U+FFFD."""
        out, run = [], bytearray()
        for i in ids.tolist():
            if self.kind[i] == 1:
                run += self.surface[i]
                continue
            out.append(_scrub(bytes(run)))
            run.clear()
            out.append(self.surface[i])
        out.append(_scrub(bytes(run)))
        return b"".join(out)

    def decode(self, ids) -> str:
        return self.decode_bytes(np.asarray(ids, np.int64)).decode()


def _scrub(run: bytes) -> bytes:
    """One U+FFFD for each byte that does not belong to a well-formed character."""
    out, at = [], 0
    while at < len(run):
        for n in (1, 2, 3, 4):
            piece = run[at : at + n]
            try:
                piece.decode()
            except UnicodeDecodeError:
                continue
            out.append(piece)
            at += n
            break
        else:
            out.append("�".encode())
            at += 1
    return b"".join(out)


@lru_cache(maxsize=4)
def tokenizer(model_path: str) -> PrefixTableBpe:
    """One table per worker and model."""
    return PrefixTableBpe(model_path)
