"""Runs of repeated words, by counts of lags.

A run is a longest stretch of words with a smallest period q and a length of at
least LEAST and EXPONENT times q. At lag q it gives length - q matches, one after
the other. So the matches of every lag are counted first, exactly: words that are
frequent in a text by the autocorrelation of their places (FFT), rare ones by the
differences of all pairs of their places. Only a lag with enough matches, besides
those that runs found at its divisors explain, is scanned for islands of matches.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .shared import map_batches, slices

LEAST, EXPONENT = 24, 3
#: Words compared at the start of each block of a lag before the whole text is.
PROBE = 32
Run = tuple[int, int, int]


def lag_matches(ids: np.ndarray, heavy: float | None = None) -> np.ndarray:
    """How many places i have ids[i] == ids[i + q], for each q up to a third of the length.

    Words with more than ``heavy`` places (set by the costs of both ways where None) are counted by FFT.
    """
    n, longest = len(ids), len(ids) // EXPONENT
    found = np.zeros(longest + 1, np.int64)
    if not longest:
        return found
    order = np.argsort(ids, kind="stable")
    starts = np.flatnonzero(np.diff(ids[order], prepend=-1))
    sizes = np.diff(starts, append=n)
    size = 1 << int(n + longest).bit_length()
    heavy = np.sqrt(size * size.bit_length()) if heavy is None else heavy
    power = np.zeros(size // 2 + 1)
    for word in np.flatnonzero(sizes > heavy):
        place = np.zeros(size)
        place[order[starts[word] : starts[word] + sizes[word]]] = 1
        spectrum = np.fft.rfft(place)
        power += spectrum.real**2 + spectrum.imag**2
    if power.any():
        found += np.rint(np.fft.irfft(power, size)[: longest + 1]).astype(np.int64)
    light = np.repeat(sizes <= heavy, sizes)
    places, groups = order[light], np.repeat(np.arange(len(sizes)), sizes)[light]
    ahead = 1
    while len(places) > ahead:  # pairs of places that are `ahead` apart among those of their word
        near = np.flatnonzero(groups[ahead:] == groups[:-ahead])
        if not len(near):
            break
        lags = places[near + ahead] - places[near]
        found += np.bincount(lags[lags <= longest], minlength=longest + 1)
        if 2 * len(near) < len(places) - ahead:  # words with fewer places have no more pairs
            still = np.isin(groups, np.unique(groups[near]))
            places, groups = places[still], groups[still]
        ahead += 1
    found[0] = 0
    return found


def _islands(ids: np.ndarray, lag: int, least: int) -> np.ndarray:
    """(start, stop) of the longest stretches of at least ``least`` matches at a lag.

    Such a stretch holds a whole block of ``lag`` places that begins at a multiple of the
    lag. So the first places of all blocks are compared before the whole text is.
    """
    blocks = np.arange(0, len(ids) - lag, lag) if lag > PROBE else ()
    for k in range(min(lag, PROBE) if len(blocks) else 0):
        at = blocks + k
        blocks = blocks[(at + lag < len(ids)) & (ids[np.minimum(at, len(ids) - 1)] == ids[np.minimum(at + lag, len(ids) - 1)])]
        if not len(blocks):
            return np.zeros((0, 2), np.int64)
    edges = np.flatnonzero(np.diff(np.concatenate([[False], ids[lag:] == ids[:-lag], [False]]))).reshape(-1, 2)
    return edges[edges[:, 1] - edges[:, 0] >= least]


def runs(ids: np.ndarray, least: int = LEAST, heavy: float | None = None) -> list[Run]:
    """(start, length, period) of every run, by start, then period."""
    if len(ids) < least:
        return []
    matches = lag_matches(ids, heavy)
    lags = np.arange(len(matches))
    needed = np.maximum(least, EXPONENT * lags) - lags
    explained, found = np.zeros_like(matches), {}
    for lag in np.flatnonzero(matches >= needed).tolist():
        if matches[lag] - explained[lag] < needed[lag]:
            continue
        for start, stop in _islands(ids, lag, int(needed[lag])).tolist():
            length = stop + lag - start
            if (start, length) not in found:  # else one of its divisors is the period
                found[start, length] = lag
                multiples = np.arange(2 * lag, min(length, len(matches)), lag)
                explained[multiples] += length - multiples
    return sorted((start, length, period) for (start, length), period in found.items())


def collapsed(n: int, found: list[Run]) -> np.ndarray:
    """Which of n words stay: all but those that some run holds after its first period."""
    depth = np.zeros(n + 1, np.int64)
    for start, length, period in found:
        depth[start + period] += 1
        depth[start + length] -= 1
    return np.cumsum(depth[:n]) == 0


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts, parted by ASCII white space, and where each text's begin; null texts have none."""
    split = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
    words, owner = split.flatten(), pc.list_parent_indices(split)
    real = pc.greater(pc.binary_length(words), 0)
    counts = np.bincount(owner.filter(real).to_numpy(), minlength=len(texts))
    return words.filter(real), np.concatenate([[0], np.cumsum(counts)])


def _longest(found: list[Run]) -> Run | None:
    """That of the greatest exponent; of equal ones the first, then that of the smaller period."""
    best = None
    for run in found:
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


Change = Callable[[object, np.ndarray], np.ndarray]


def run_report(docs: DataFrame, least: int = LEAST, change: Change | None = None, texts: bool = False) -> DataFrame:
    """The runs of each row's text: all as an array, the one of the greatest exponent, and the text without repeats.

    ``change`` gives the places of the words to take from (doc_id, places). With ``texts``
    the column collapsed_text holds the words that stay. Null and blank texts have no
    words and no runs; repeated rows are rows of the result; a null doc_id stays null.
    Work is within a row: a text is never shuffled, and one word id a word is held.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string, runs array<struct<start:long,length:long,period:long>>"
    schema += ", collapsed_text string" if texts else ""
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            words, starts = words_of(batch["text"])
            code = words.dictionary_encode()
            ids, rows = code.indices.to_numpy().astype(np.int64), []
            for doc_id, a, b in zip(batch["doc_id"].to_pylist(), starts, starts[1:]):
                places = np.arange(a, b)
                if change is not None and b > a:
                    places = a + change(doc_id, places - a)
                found = runs(ids[places], least)
                stays = places[collapsed(len(places), found)] if found else places
                kept = pc.binary_join(pa.ListArray.from_arrays([0, len(stays)], code.dictionary.take(pa.array(ids[stays]))), pa.scalar(" ", pa.large_string()))[0].as_buffer()
                told = hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in found).encode()).hexdigest()
                best = _longest(found) or (None, None, None)
                milli = 1000 * best[1] // best[2] if found else None
                row = (doc_id, len(found), *best, milli, told, hashlib.sha256(kept).hexdigest(), [dict(zip(("start", "length", "period"), r)) for r in found])
                rows.append((*row, kept.to_pybytes().decode()) if texts else row)
            types = [batch.schema.field("doc_id").type, *[pa.int64()] * 5, pa.string(), pa.string(), run_type, *([pa.string()] if texts else [])]
            names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256", "runs", *(["collapsed_text"] if texts else [])]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    return map_batches(docs.select("doc_id", "text"), report, schema)


def planted(doc_id: object, places: np.ndarray) -> np.ndarray:
    """Places of the words to take: every tenth document, by its id's checksum, repeats from some place on."""
    if doc_id is None:
        return places
    h, n = zlib.crc32(str(doc_id).encode()), len(places)
    if h % 10:
        return places
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return np.where(places < a, places, a + (places - a) % p)


def op12(docs: DataFrame) -> DataFrame:
    """Runs of all documents, with the repeats that the ids plant; a null doc_id plants none."""
    return run_report(docs, change=planted).drop("runs")
