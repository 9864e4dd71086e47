"""Fill-in-middle transformation of documents kept as seekable compressed frames (operator 12).

Method: a text is stored as independent zstandard frames with the number of code points up
to the end of each. A cut decompresses only the frames it falls into; digests stream the
frames in order, so a worker holds one plain frame and a text's compressed frames at a time.

Null texts count as empty; empty texts, and texts that hold a marker, stay plain. A missing
doc_id draws as the empty text would. Repeated rows are transformed each, in the same way.
"""

from __future__ import annotations

import functools
import hashlib
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import chain

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerflow.llm.common import keep, map_slices

#: Code points of one frame; bounds what is plain at a time.
FRAME_UNITS = 1 << 16
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"

_compressor = functools.cache(lambda: zstandard.ZstdCompressor(level=3))
_decompressor = functools.cache(zstandard.ZstdDecompressor)

_FRAMES = "n long, ends array<long>, frames array<binary>"


@dataclass
class SeekableText:
    """Frames of a text, and the number of code points up to the end of each."""

    ends: list[int]
    frames: list[bytes]
    _plain: tuple[int, str] = field(default=(-1, ""), repr=False)

    @staticmethod
    def of(pieces: Iterable[str], units: int = FRAME_UNITS) -> SeekableText:
        """Frames of `units` code points each, but for the last; empty text has none."""
        made, held, n = SeekableText([], []), [], 0
        for piece in pieces:
            at = 0
            while at < len(piece):
                held.append(piece[at : at + units - n])
                at += len(held[-1])
                n += len(held[-1])
                if n == units:
                    made._add(held, n)
                    held, n = [], 0
        if n:
            made._add(held, n)
        return made

    def _add(self, held: list[str], n: int) -> None:
        self.ends.append(len(self) + n)
        self.frames.append(_compressor().compress("".join(held).encode()))

    def __len__(self) -> int:
        return self.ends[-1] if self.ends else 0

    def between(self, start: int, stop: int) -> Iterator[str]:
        """The code points from `start` to before `stop`, in pieces; other frames stay closed."""
        at = bisect_right(self.ends, start)
        while start < stop and at < len(self.ends):
            first = self.ends[at - 1] if at else 0
            yield self._open(at)[start - first : stop - first]
            start, at = self.ends[at], at + 1

    def pieces(self) -> Iterator[str]:
        return self.between(0, len(self))

    def find(self, mark: str) -> int:
        """Place of the first `mark`, also across the border of two frames; -1 if there is none."""
        rest, at = "", 0
        for piece in self.pieces():
            window = rest + piece
            place = window.find(mark)
            if place >= 0:
                return at - len(rest) + place
            at += len(piece)
            rest = window[1 - len(mark) :]
        return -1

    def _open(self, at: int) -> str:
        if self._plain[0] != at:
            self._plain = (at, _decompressor().decompress(self.frames[at]).decode())
        return self._plain[1]


def rearranged(text: SeekableText, form: str, first: int, second: int) -> Iterator[str]:
    """The pieces of a text cut before units `first` and `second`, in the order of its form."""
    if form == "plain":
        return text.pieces()
    prefix, middle, suffix = text.between(0, first), text.between(first, second), text.between(second, len(text))
    if form == "psm":
        return chain([PREFIX], prefix, [SUFFIX], suffix, [MIDDLE], middle)
    return chain([SUFFIX], suffix, [PREFIX], prefix, [MIDDLE], middle)


def restored(output: SeekableText, form: str) -> Iterator[str]:
    """The pieces of the text that `rearranged` was given. A text without markers makes none at its cuts."""
    if form == "plain":
        return output.pieces()
    inner, last = output.find(SUFFIX if form == "psm" else PREFIX), output.find(MIDDLE)
    head, tail = (len(PREFIX), inner), (inner + len(SUFFIX), last)
    prefix, suffix = (head, tail) if form == "psm" else (tail, head)
    return chain(output.between(*prefix), output.between(last + len(MIDDLE), len(output)), output.between(*suffix))


def frame_texts(docs: DataFrame, units: int = FRAME_UNITS) -> DataFrame:
    """Per row of `docs`: doc_id, n (code points), ends and frames, and whether the text holds a marker."""

    def work():
        def batch(part: pa.RecordBatch) -> dict:
            texts = [text or "" for text in part.column("text").to_pylist()]
            made = [SeekableText.of([text], units) for text in texts]
            marks = (PREFIX, SUFFIX, MIDDLE)
            return {"doc_id": part.column("doc_id"), "marked": pa.array([any(m in t for m in marks) for t in texts], pa.bool_())} | _columns(made)

        return batch

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_slices(rows, work, f"doc_id long, marked boolean, {_FRAMES}")


def with_cuts(framed: DataFrame, seed: int = 1, transformed_percent: int = 90, spm_percent: int = 20) -> DataFrame:
    """Adds form, prefix_chars and middle_chars (null if plain), all drawn from the seed and the id."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    drawn = F.sha2(name, 256)
    h = [F.conv(F.substring(drawn, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]
    places = [h[0] % (F.col("n") + 1), h[1] % (F.col("n") + 1)]
    plain = (F.col("n") == 0) | F.col("marked") | (h[2] % 100 >= transformed_percent)
    form = F.when(plain, "plain").when(h[3] % 100 < spm_percent, "spm").otherwise("psm")
    cut = framed.withColumn("form", form)
    kept = F.col("form") != "plain"
    first, second = F.least(*places), F.greatest(*places)
    return cut.withColumns({"prefix_chars": F.when(kept, first), "middle_chars": F.when(kept, second - first)}).drop("marked")


def rearrange(cut: DataFrame, units: int = FRAME_UNITS) -> DataFrame:
    """Rows of `with_cuts`, with the frames of the rearranged texts in place of the original ones.

    n, prefix_chars and middle_chars stay those of the original text.
    """

    def work():
        def batch(part: pa.RecordBatch) -> dict:
            made = []
            for row in _rows(part, "form", "prefix_chars", "middle_chars"):
                first = row["prefix_chars"] or 0
                text = SeekableText(row["ends"], row["frames"])
                made.append(SeekableText.of(rearranged(text, row["form"], first, first + (row["middle_chars"] or 0)), units))
            names = ("doc_id", "n", "form", "prefix_chars", "middle_chars")
            return _columns(made) | {name: part.column(name) for name in names}

        return batch

    schema = f"doc_id long, form string, prefix_chars long, middle_chars long, {_FRAMES}"
    return map_slices(cut, work, schema)


def transform(docs: DataFrame, units: int = FRAME_UNITS, seed: int = 1) -> DataFrame:
    """Documents as frames of their fill-in-middle form: doc_id, n, form, prefix_chars, middle_chars, ends, frames."""
    return rearrange(with_cuts(keep(frame_texts(docs, units), "frames"), seed), units)


def digests(transformed: DataFrame) -> DataFrame:
    """SHA-256 of each output, and of the text rebuilt from output and form, by streams over the frames."""

    def work():
        def batch(part: pa.RecordBatch) -> dict:
            rows = [(SeekableText(row["ends"], row["frames"]), row["form"]) for row in _rows(part, "form")]
            names = ("doc_id", "n", "form", "prefix_chars", "middle_chars")
            return {name: part.column(name) for name in names} | {
                "output_sha256": pa.array([_digest(text.pieces()) for text, _ in rows], pa.string()),
                "restored_sha256": pa.array([_digest(restored(text, form)) for text, form in rows], pa.string()),
            }

        return batch

    schema = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string"
    return map_slices(transformed, work, schema)


def texts_between(framed: DataFrame, start: int, stop: int) -> DataFrame:
    """doc_id and `text`: the code points from `start` to before `stop`, from the frames that hold them."""

    def work():
        def batch(part: pa.RecordBatch) -> dict:
            found = ["".join(SeekableText(row["ends"], row["frames"]).between(start, stop)) for row in _rows(part)]
            return {"doc_id": part.column("doc_id"), "text": pa.array(found, pa.string())}

        return batch

    return map_slices(framed.select("doc_id", "ends", "frames"), work, "doc_id long, text string")


def _rows(part: pa.RecordBatch, *more: str) -> Iterator[dict]:
    """One row at a time, so that only its own frames are Python objects."""
    names = ("ends", "frames", *more)
    columns = [part.column(name) for name in names]
    for i in range(part.num_rows):
        yield {name: column[i].as_py() for name, column in zip(names, columns, strict=True)}


def _columns(made: list[SeekableText]) -> dict:
    return {
        "n": pa.array(map(len, made), pa.int64()),
        "ends": pa.array([text.ends for text in made], pa.list_(pa.int64())),
        "frames": pa.array([text.frames for text in made], pa.list_(pa.binary())),
    }


def _digest(pieces: Iterable[str]) -> str:
    found = hashlib.sha256()
    for piece in pieces:
        found.update(piece.encode())
    return found.hexdigest()
