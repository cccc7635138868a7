"""Fill-in-the-middle rewriting of documents.

One full match of a repeated group keeps the end of every repetition: the number of ends
is the number of units, and the ends at two drawn numbers are the cuts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .words import runs, texts_of

#: Markers of prefix, suffix and middle (fixed values).
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Any code point.
CODE_POINT = r"."
#: Characters of one match: the library keeps every repetition, some 50 bytes each.
STRETCH = 1 << 20
#: Percent of documents that are rewritten, and of these in the order suffix, prefix, middle.
RATE, SPM_RATE = 90, 20


class Cutter:
    """Cuts texts into units, matched left to right."""

    def __init__(self, unit: str = CODE_POINT, stretch: int = STRETCH):
        self.pattern, self.stretch = regex.compile(rf"(?s:({unit}))*"), stretch

    def ends(self, text: str) -> list[list[int]]:
        """Ends of the units, one list for each stretch of the text; a unit does not run over the end of a stretch."""
        out = []
        for lo in range(0, len(text), self.stretch):
            found = self.pattern.fullmatch(text, lo, min(len(text), lo + self.stretch))
            if found is None:
                raise ValueError("the unit does not cover the text")
            out.append(found.ends(1))
        return out

    def cuts(self, text: str, draws: list[int]) -> tuple[int, list[int]]:
        """(n, for each draw the place after draw % (n + 1) units)."""
        parts = self.ends(text)
        n = sum(map(len, parts))

        def place(units: int) -> int:
            if not units:
                return 0
            for part in parts:
                if units <= len(part):
                    return part[units - 1]
                units -= len(part)
            raise IndexError(units)

        return n, [place(d % (n + 1)) for d in draws]


def draws(key: str) -> list[int]:
    """h1 to h4 of a key."""
    digest = hashlib.sha256(f"1:{key}".encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]


def transform(text: str, key: str, cutter: Cutter) -> tuple[int, str, str, int | None, int | None]:
    """(n, form, output, characters of the prefix, of the middle) of one text."""
    h1, h2, h3, h4 = draws(key)
    n, cuts = cutter.cuts(text, [h1, h2])
    if not text or any(m in text for m in (PREFIX, SUFFIX, MIDDLE)) or h3 % 100 >= RATE:
        return n, "plain", text, None, None
    lo, hi = sorted(cuts)
    prefix, middle, suffix = text[:lo], text[lo:hi], text[hi:]
    if h4 % 100 < SPM_RATE:
        return n, "spm", f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}", lo, hi - lo
    return n, "psm", f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}", lo, hi - lo


def restore(output: str, form: str) -> str:
    """The text that `output` was made of. No marker stands inside a piece, so the first of each is the one that was put there."""
    if form == "plain":
        return output
    first, second = (SUFFIX, PREFIX) if form == "spm" else (PREFIX, SUFFIX)
    head, rest = output.removeprefix(first).split(second, 1)
    tail, middle = rest.split(MIDDLE, 1)
    return tail + middle + head if form == "spm" else head + middle + tail


def _sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def fill_in_middle(docs: DataFrame, key: str = "doc_id", column: str = "text", unit: str = CODE_POINT, with_output: bool = True) -> DataFrame:
    """key, n, form, output, prefix_chars, middle_chars, output_sha256, restored_sha256: one row for each row of `docs`.

    A text is cut after two drawn numbers of units and written as psm or spm (see
    `transform`) or left plain; the draws depend on the key alone, so equal keys are cut by
    equal draws and reruns agree. restored_sha256 is of the text rebuilt from the output.
    A null text is an empty one, which stays plain; a null key draws as the word null; an
    empty table gives an empty result. Other columns of `docs` are not read. A row costs
    its own text alone: texts of over STRETCH characters are matched in stretches, so the
    kept repetitions of one match stay below some 50 MB. Without `with_output` the output
    is left out.
    """
    schema = f"key string, n long, form string,{' output string,' if with_output else ''} prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = Cutter(unit)
        for batch in batches:
            texts, keys = texts_of(batch), ["null" if k is None else k for k in batch.column("draw_key").to_pylist()]
            for lo, hi in runs(texts):
                made = [transform(t, k, cutter) for t, k in zip(texts[lo:hi], keys[lo:hi], strict=True)]
                n, form, output, prefix, middle = map(list, zip(*made, strict=True))
                columns = {"key": batch.column("key").slice(lo, hi - lo), "n": pa.array(n, pa.int64()), "form": pa.array(form, pa.string())}
                if with_output:
                    columns["output"] = pa.array(output, pa.string())
                restored = [_sha256(restore(o, f)) for o, f in zip(output, form, strict=True)]
                columns |= {"prefix_chars": pa.array(prefix, pa.int64()), "middle_chars": pa.array(middle, pa.int64()), "output_sha256": pa.array([_sha256(o) for o in output]), "restored_sha256": pa.array(restored)}
                yield pa.RecordBatch.from_pydict(columns)

    rows = docs.select(docs[key].alias("key"), docs[key].cast("string").alias("draw_key"), docs[column].alias("text"))
    out = rows.mapInArrow(run, schema.replace("key string", f"key {rows.schema['key'].dataType.simpleString()}", 1))
    return out.withColumnRenamed("key", key)
