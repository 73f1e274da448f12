"""Fill-in-the-middle by displacement scatter.

A part of an Arrow batch is one array of bytes. A scan finds the ends of its tokens, a hash of doc_id picks two cuts a
text, and each of the three pieces gets one displacement: how far its bytes lie from their place in the output.
Written as differences at the pieces' first bytes, displacements become every byte's shift by one cumulative sum, and a
scatter puts all bytes of the part in place. The inverse finds the markers in the output, writes the differences of the
restored text and gathers: it sees outputs and forms only.

Tokens are words with the white space before them; white space at the end is a token. No marker can arise where pieces
meet, as each marker starts and ends with bytes that stand nowhere else in it.

Cases. Null text: the empty text, hence plain. Null doc_id: hashed as empty digits. Repeated rows and equal texts: rows
of their own, equal rows alike. Texts that hold a marker: plain. A text of any length is handled whole, its shifts
``WINDOW`` bytes at a time. A row whose form isn't one of the three, or whose output lacks a marker that its form needs
once, is restored as null. An empty table gives an empty result. Further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.llm.bytescan import parts, range_sums, string_array, text_bytes, word_ends
from skein.llm.common import documents, need

#: Share of texts that are transformed, and of those that take the form spm, in hundredths.
RATE = 50
SPM_RATE = 80
SEED = 42
#: Bytes whose shifts are held at once.
WINDOW = 1 << 20

FORMS = np.array(["plain", "psm", "spm"], dtype=object)
PLAIN, PSM, SPM = range(3)
MARKS = b"PSM"  # the letters of the markers of prefix, suffix and middle

MADE = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def draws(doc_ids: list[int | None], seed: int) -> np.ndarray:
    """Four unsigned numbers of 32 bits for each doc_id."""
    digests = b"".join(hashlib.sha256(f"{seed}:{'' if d is None else d}".encode()).digest()[:16] for d in doc_ids)
    return np.frombuffer(digests, ">u4").astype(np.int64).reshape(-1, 4)


def marks(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, place and letter (0 prefix, 1 suffix, 2 middle) of every marker inside a text."""
    at = np.flatnonzero(data[:-2] == ord("<"))
    at = at[data[at + 2] == ord(">")] if len(at) else at
    row = np.searchsorted(offsets, at, "right") - 1
    letter = np.full(256, -1)
    letter[list(MARKS)] = range(3)
    which = letter[data[at + 1]] if len(at) else at
    held = (which >= 0) & (at + 3 <= offsets[row + 1]) if len(at) else np.zeros(0, bool)
    return row[held], at[held], which[held]


def shifts(starts: np.ndarray, moves: np.ndarray, size: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each window of ``size`` places, its first place and the shift of each place.

    A piece that starts at ``starts`` (ascending, repeats where pieces are empty) is moved by ``moves``.
    """
    steps = np.diff(moves, prepend=0)
    carry = 0
    for w in range(0, size, WINDOW):
        lo, hi = np.searchsorted(starts, [w, min(w + WINDOW, size)])
        difference = np.zeros(min(WINDOW, size - w), np.int64)
        np.add.at(difference, starts[lo:hi] - w, steps[lo:hi])
        difference[0] += carry
        shift = np.cumsum(difference)
        carry = shift[-1]
        yield w, shift


def cut(offsets: np.ndarray, data: np.ndarray, draw: np.ndarray, rate: int, spm: int):
    """n, form, and the two cuts of each text."""
    first, end = offsets[:-1], offsets[1:]
    ends = word_ends(offsets, data)
    lo, hi = np.searchsorted(ends, first, "right"), np.searchsorted(ends, end, "right")
    words = hi - lo
    behind = np.where(words > 0, ends[np.maximum(hi - 1, 0)] if len(ends) else 0, first)
    n = words + (behind < end)
    marked = np.zeros(len(n), bool)
    marked[marks(offsets, data)[0]] = True
    plain = (end == first) | marked | (draw[:, 2] % 100 >= rate)
    form = np.where(plain, PLAIN, np.where(draw[:, 3] % 100 < spm, SPM, PSM))
    units = np.sort(draw[:, :2] % (n + 1)[:, None], axis=1)

    def place(u):
        inside = np.clip(lo + u - 1, 0, max(len(ends) - 1, 0))
        return np.where(u == 0, first, np.where(u <= words, ends[inside] if len(ends) else first, end))

    c1, c2 = place(units[:, 0]), place(units[:, 1])
    return n, form, np.where(plain, end, c1), np.where(plain, end, c2)


def scatter(offsets: np.ndarray, data: np.ndarray, form: np.ndarray, c1: np.ndarray, c2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of the outputs."""
    first, end = offsets[:-1], offsets[1:]
    made = form != PLAIN
    at = np.concatenate([[0], np.cumsum(end - first + 9 * made)])
    q, prefix, suffix = at[:-1], c1 - first, end - c2
    spm = form == SPM
    to_prefix = q + np.where(spm, 6 + suffix, 3 * made)
    to_suffix = q + np.where(spm, 3, 6 + prefix) * made + np.where(made, 0, prefix)
    to_middle = np.where(made, q + 9 + prefix + suffix, q + prefix)
    starts = np.column_stack([first, c1, c2]).ravel()
    moves = np.column_stack([to_prefix - first, to_middle - c1, to_suffix - c2]).ravel()
    out = np.empty(at[-1], np.uint8)
    for w, shift in shifts(starts, moves, len(data)):
        here = np.arange(w, w + len(shift))
        out[here + shift] = data[w : w + len(shift)]
    for letter, to in zip(MARKS, (to_prefix, to_suffix, to_middle), strict=True):
        for k, byte in enumerate((ord("<"), letter, ord(">"))):
            out[to[made] - 3 + k] = byte
    return at, out


def gather(offsets: np.ndarray, data: np.ndarray, form: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Offsets and bytes of the texts that outputs of these forms come from, and whether each output is of its form."""
    first, end = offsets[:-1], offsets[1:]
    row, place, which = marks(offsets, data)
    made = (form == PSM) | (form == SPM)
    p, s, m = (np.full(len(form), -1) for _ in MARKS)
    times = np.zeros((len(form), 3), np.int64)
    np.add.at(times, (row, which), 1)
    for k, where in enumerate((p, s, m)):
        where[row[which == k]] = place[which == k]
    spm = form == SPM
    ordered = np.where(spm, (s == first) & (s < p) & (p < m), (p == first) & (p < s) & (s < m))
    valid = (form == PLAIN) | made & (times == 1).all(axis=1) & ordered
    made &= valid
    plain = valid & ~made
    lengths = [
        np.where(made, np.where(spm, m, s) - p - 3, np.where(plain, end - first, 0)),  # prefix
        np.where(made, end - m - 3, 0),  # middle
        np.where(made, np.where(spm, p, m) - s - 3, 0),  # suffix
    ]
    sources = [np.where(made, p + 3, first), np.where(made, m + 3, first), np.where(made, s + 3, first)]
    at = np.concatenate([[0], np.cumsum(sum(lengths))])
    starts = np.column_stack([at[:-1], at[:-1] + lengths[0], at[:-1] + lengths[0] + lengths[1]])
    moves = (np.column_stack(sources) - starts).ravel()
    text = np.empty(at[-1], np.uint8)
    for w, shift in shifts(starts.ravel(), moves, len(text)):
        text[w : w + len(shift)] = data[np.arange(w, w + len(shift)) + shift]
    return at, text, valid


def infill(docs: DataFrame, rate: int = RATE, spm: int = SPM_RATE, seed: int = SEED) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output of every row of ``docs`` (doc_id, text)."""

    def work(batches):
        for batch in batches:
            for part in parts(batch, "text"):
                offsets, data = text_bytes(part.column("text"))
                n, form, c1, c2 = cut(offsets, data, draws(part.column("doc_id").to_pylist(), seed), rate, spm)
                lead = (data & 0xC0) != 0x80
                chars = range_sums(lead, np.append(np.column_stack([offsets[:-1], c1, c2]).ravel(), offsets[-1])).reshape(-1, 3)
                made = form != PLAIN
                counts = [pa.array(chars[:, k], pa.int64(), mask=~made) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(n, pa.int64()), pa.array(FORMS[form], pa.string()), *counts, string_array(*scatter(offsets, data, form, c1, c2))],
                    names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
                )

    return need(docs, doc_id=T.LongType(), text=T.StringType()).mapInArrow(work, MADE)


def restore(made: DataFrame) -> DataFrame:
    """``made`` (form, output, further columns) with restored: the text that each output comes from."""
    schema = T.StructType([*made.schema.fields, T.StructField("restored", T.StringType())])
    names = schema.fieldNames()

    def work(batches):
        code = {f: k for k, f in enumerate(FORMS)}
        for batch in batches:
            for part in parts(batch, "output"):
                form = np.fromiter((code.get(f, -1) for f in part.column("form").to_pylist()), np.int64, part.num_rows)
                form[part.column("output").is_null().to_numpy(zero_copy_only=False)] = -1
                yield pa.RecordBatch.from_arrays([*part.columns, string_array(*gather(*text_bytes(part.column("output")), form))], names=names)

    return made.mapInArrow(work, schema)


def op11_displacement_infill(spark, sf_dir: str) -> DataFrame:
    """Digests of every document's output and of the text restored from it."""
    digest = lambda c: F.sha2(F.col(c).cast("binary"), 256)
    both = restore(infill(documents(spark, sf_dir, "doc_id", "text")))
    return both.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest("output").alias("output_sha256"), digest("restored").alias("restored_sha256"))


OP11_SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
    regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS tokens
  FROM documents
), d AS (
  SELECT *, CAST(len(tokens) AS BIGINT) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
    CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4
  FROM t
), c AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS lo, greatest(h1 % (n + 1), h2 % (n + 1)) AS hi,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain'
      WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM d
), p AS (
  SELECT *, array_to_string(tokens[1:lo], '') AS prefix, array_to_string(tokens[lo + 1:hi], '') AS middle, array_to_string(tokens[hi + 1:], '') AS suffix FROM c
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM p
"""
