"""Signals of all tasks met with files as they stream by: what grows as tasks times files is never moved or written.

A task's words and a file's words meet in one Arrow batch of files, where numpy forms the pairs of a bounded number of
files at a time; only what is asked for leaves it: all hits, one score for a pair, or the first pairs of each task. Workers
hold the signals (some 60 bytes each); tasks are taken TASKS at a time where each task's first pairs are kept.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..sources.shared import bound_batches

#: Pairs, or hits, that are formed at once; tasks of a pass.
BLOCK, TASKS = 1 << 21, 4096


def round6(x: np.ndarray) -> np.ndarray:
    return np.floor(x * 1_000_000 + 0.5) / 1_000_000.0


def _spread(start: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, place): for each owner i the places start[i], start[i] + 1, ..., count[i] of them."""
    owner = np.repeat(np.arange(len(count)), count)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(count) - count - start, count)


class Signals:
    """Signals (sid, task_id, tid, w1, w2, w3, normalized, signal_kind, origin, value) by term; w: the weight of 1, 2 and 3 occurrences."""

    def __init__(self, rows: pa.Table):
        rows = rows.sort_by([(c, "ascending") for c in ("task_id", "normalized", "signal_kind", "origin")])
        of = lambda c: rows.column(c).combine_chunks().to_numpy(zero_copy_only=False)
        tid = of("tid").astype(np.int64)
        by_term = np.argsort(tid, kind="stable")
        self.terms, self.first, self.many = np.unique(tid[by_term], return_index=True, return_counts=True)
        self.task_ids, task = np.unique(of("task_id"), return_inverse=True)
        # in the order of a task's signals: which of them come first among equals
        self.sid, self.task, self.place = of("sid")[by_term], task[by_term], by_term
        self.weights = np.stack([of(w).astype(np.float64) for w in ("w1", "w2", "w3")])[:, by_term]
        value = np.array([f"{t}\0{v}" for t, v in zip(task.tolist(), rows.column("value").to_pylist(), strict=True)], dtype=object)
        _, value, times = np.unique(value, return_inverse=True, return_counts=True) if len(value) else (None, np.zeros(0, np.int64), np.zeros(0, np.int64))
        self.value = np.where(times[value] > 1, value, -1)[by_term] if len(value) else value  # -1: no other signal of the task has it

    def hits(self, tid: np.ndarray, n: np.ndarray, file: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(file, signal, n): the signals of terms that files hold n times."""
        at = np.searchsorted(self.terms, tid)
        known = at < len(self.terms)
        known[known] = self.terms[at[known]] == tid[known]
        at, n, file = at[known], n[known], file[known]
        owner, signal = _spread(self.first[at], self.many[at])
        return file[owner], signal, n[owner]


class First:
    """The k first pairs of each task, by descending score, the file's turn and its path."""

    def __init__(self, tasks: int, k: int):
        self.k, self.least = k, np.zeros(tasks)
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.size, self.bound = 0, max(BLOCK, 2 * k * tasks)

    def add(self, task: np.ndarray, score: np.ndarray, turn: np.ndarray, path: np.ndarray) -> None:
        keep = score >= self.least[task]
        self.parts.append((task[keep], score[keep], turn[keep], path[keep]))
        self.size += int(keep.sum())
        if self.size > self.bound:
            self.cut()

    def cut(self) -> tuple[np.ndarray, ...]:
        if not self.parts:
            return np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64), np.zeros(0, object)
        task, score, turn, path = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        names = {p: i for i, p in enumerate(sorted(set(path.tolist())))}  # by code points, as UTF-8 sorts
        order = np.lexsort((np.array([names[p] for p in path.tolist()], np.int64), turn, -score, task))
        task = task[order]
        place = np.arange(len(task)) - np.searchsorted(task, task, "left")
        order, task, place = order[place < self.k], task[place < self.k], place[place < self.k]
        last = place == self.k - 1
        self.least[task[last]] = score[order][last]
        self.parts = [(task, score[order], turn[order], path[order])]
        self.size = len(task)
        return self.parts[0]


def best_hits(s: Signals, file: np.ndarray, signal: np.ndarray, n: np.ndarray, most: int) -> tuple[np.ndarray, ...]:
    """(pair, signal, n, weight) of the `most` hits of each pair of a file and a task, by weight and then name; pairs in order."""
    pair = file * len(s.task_ids) + s.task[signal]
    order = np.argsort(pair, kind="stable")
    pair, signal, n = pair[order], signal[order], n[order]
    weight = s.weights[np.minimum(n, 3) - 1, signal]
    size = np.searchsorted(pair, pair, "right") - np.searchsorted(pair, pair, "left")
    if (size > most).any():
        order = np.lexsort((s.place[signal], -weight, pair))
        pair, signal, n, weight = pair[order], signal[order], n[order], weight[order]
        keep = np.arange(len(pair)) - np.searchsorted(pair, pair, "left") < most
        pair, signal, n, weight = pair[keep], signal[keep], n[keep], weight[keep]
    return pair, signal, n, weight


def once(s: Signals, pair: np.ndarray, signal: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Which hits stay of those that share a pair and a value: one of most weight."""
    keep = np.ones(len(pair), bool)
    several = np.flatnonzero(s.value[signal] >= 0)
    if len(several):
        value = s.value[signal[several]]
        order = np.lexsort((-weight[several], value, pair[several]))
        a, v = pair[several][order], value[order]
        again = np.zeros(len(order), bool)
        again[1:] = (a[1:] == a[:-1]) & (v[1:] == v[:-1])
        keep[several[order[again]]] = False
    return keep


def _files(batch: pa.RecordBatch, s: Signals) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first file, past file, file, tid, n) of a bounded number of hits. batch: path, terms (list of tid and n)."""
    lists = batch.column("terms")
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten()
    tid, n = (flat.field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
    file = np.repeat(np.arange(len(sizes)), sizes)
    at = np.minimum(np.searchsorted(s.terms, tid), max(len(s.terms) - 1, 0))
    many = np.where(s.terms[at] == tid, s.many[at], 0) if len(s.terms) else np.zeros(len(tid), np.int64)
    upto = np.concatenate([[0], np.cumsum(np.bincount(file, many, len(sizes)))])
    ends, a = np.concatenate([[0], np.cumsum(sizes)]), 0
    while a < len(sizes):
        z = max(a + 1, min(len(sizes), int(np.searchsorted(upto, upto[a] + BLOCK, "right")) - 1))
        i, j = ends[a], ends[z]
        yield a, z, file[i:j] - a, tid[i:j], n[i:j]
        a = z


def _runs(s: Signals, most: int) -> Callable:
    """What a batch of files gives: (batch, first file, pair, signal, n, weight)."""

    def of(batch: pa.RecordBatch) -> Iterator[tuple]:
        for a, z, file, tid, n in _files(batch, s):
            file, signal, n = s.hits(tid, n, file)
            if "tasks" in batch.schema.names:  # only these tasks of a file
                lists = batch.column("tasks").slice(a, z - a)
                asked = np.repeat(np.arange(z - a), lists.value_lengths().to_numpy(zero_copy_only=False)) * len(s.task_ids)
                ids = lists.flatten().to_numpy(zero_copy_only=False)
                at = np.minimum(np.searchsorted(s.task_ids, ids), len(s.task_ids) - 1)
                wanted = np.unique((asked + at)[s.task_ids[at] == ids])
                pair = file * len(s.task_ids) + s.task[signal]
                keep = np.isin(pair, wanted) != bool(batch.column("others")[0].as_py())
                file, signal, n = file[keep], signal[keep], n[keep]
            if len(file):
                yield (a, *best_hits(s, file, signal, n, most))

    return of


def hits(rows: DataFrame, s: Signals, most: int) -> DataFrame:
    """(path, sid, n): the hits of files (path, terms and, if only some tasks are asked for, tasks and others: whether the others are)."""
    bound_batches(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = _runs(s, most)
        for batch in batches:
            for a, pair, signal, n, _ in of(batch):
                for i in range(0, len(pair), 1 << 17):
                    j = slice(i, i + (1 << 17))
                    paths = batch.column("path").take(pa.array(a + pair[j] // len(s.task_ids)))
                    yield pa.RecordBatch.from_arrays([paths, pa.array(s.sid[signal[j]]), pa.array(n[j].astype(np.int32))], ["path", "sid", "n"])

    return rows.mapInArrow(run, "path string, sid long, n int")


def scores(rows: DataFrame, s: Signals, most: int, score: Callable, kind: str, k: int | None = None) -> DataFrame:
    """(task_id, path, score) of files (path, turn, terms, ...) that have hits, or the k first of each task in each partition, which hold the k first of all.

    score(signals, first hit of each pair, hits): the scores of pairs in order."""
    bound_batches(rows.sparkSession)
    tasks = len(s.task_ids)

    def out(task: np.ndarray, paths: pa.Array, score: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(s.task_ids[task]), paths, pa.array(score)], ["task_id", "path", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = _runs(s, most)
        first = First(tasks, k) if k else None
        for batch in batches:
            path = batch.column("path").to_numpy(zero_copy_only=False) if k else None
            turn = batch.column("turn").to_numpy(zero_copy_only=False) if k else None
            for a, pair, signal, _, weight in of(batch):
                keep = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))
                value, at = score(s, pair, signal, weight, keep), pair[keep]
                file, task = a + at // tasks, at % tasks
                if first:
                    first.add(task, value, turn[file], path[file])
                    continue
                for i in range(0, len(task), 1 << 17):
                    j = slice(i, i + (1 << 17))
                    yield out(task[j], batch.column("path").take(pa.array(file[j])), value[j])
        if first:
            task, value, _, path = first.cut()
            yield out(task, pa.array(path, pa.string()), value)

    return rows.mapInArrow(run, f"task_id {kind}, path string, score double")


def sums(rows: DataFrame, s: Signals, most: int) -> DataFrame:
    """(n, millionths) in parts: the number of hits, those of one value counting once, and their weights' sum."""
    bound_batches(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, n, millionths = _runs(s, most), 0, 0
        for batch in batches:
            for _, pair, signal, _, weight in of(batch):
                keep = once(s, pair, signal, weight)
                n += int(keep.sum())
                millionths += int(np.floor(weight[keep] * 1_000_000 + 0.5).sum())
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([millionths])], ["n", "millionths"])

    return rows.mapInArrow(run, "n long, millionths long")


def total(s: Signals, pair: np.ndarray, signal: np.ndarray, weight: np.ndarray, first: np.ndarray) -> np.ndarray:
    return round6(np.add.reduceat(weight, first))


def capped(by_signal: float, by_family: float) -> Callable:
    """The score of words alone: each value's weight under one cap, their sum under another."""

    def score(s: Signals, pair: np.ndarray, signal: np.ndarray, weight: np.ndarray, first: np.ndarray) -> np.ndarray:
        own = np.where(once(s, pair, signal, weight), np.minimum(round6(weight), by_signal), 0.0)
        return round6(np.minimum(by_family, np.add.reduceat(own, first)))

    return score


class Substrings:
    """Distinct terms without line breaks, looked for at every place of texts at once: by their bytes up to eight, held as
    numbers; what is longer is looked at where its first eight bytes stand."""

    BITS = 22

    def __init__(self, terms: list[str]):
        self.bytes = [t.encode() for t in terms]
        self.size = np.array([len(b) for b in self.bytes], np.int64)
        key = np.array([int.from_bytes(b[:8].ljust(8, b"\0"), "big") for b in self.bytes], np.uint64)
        # a term that ends as it begins may overlap itself
        self.overlaps = np.array([any(b[:i] == b[-i:] for i in range(1, len(b))) for b in self.bytes], bool)
        self.by_size = []
        for size in range(1, 9):
            own = np.flatnonzero(self.size == size if size < 8 else self.size >= 8)
            if len(own):
                own = own[np.argsort(key[own], kind="stable")]
                keys, first, many = np.unique(key[own], return_index=True, return_counts=True)
                seen = np.zeros(1 << self.BITS, bool)
                seen[self._slot(keys)] = True
                self.by_size.append((np.uint64((1 << 64) - (1 << (64 - 8 * size))), seen, keys, own, first, many))

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.BITS)

    def counts(self, texts: list[bytes]) -> np.ndarray:
        """How often each text (a row) holds each term (a column), as far as they don't overlap."""
        data = b"\n".join(texts) + b"\n" * 9
        ends = np.cumsum([len(t) + 1 for t in texts])
        n = int(ends[-1])
        at8 = np.empty(n, np.uint64)
        for o in range(min(8, n)):
            at8[o::8] = np.frombuffer(data, ">u8", (n - o + 7) // 8, o) if o + 8 * ((n - o + 7) // 8) <= len(data) else np.frombuffer(data + b"\n" * 8, ">u8", (n - o + 7) // 8, o)
        width = len(self.bytes)
        out = np.zeros(len(texts) * width, np.int64)
        for mask, seen, keys, own, first, many in self.by_size:
            here = at8 & mask
            place = np.flatnonzero(seen[self._slot(here)])
            at = np.minimum(np.searchsorted(keys, here[place]), len(keys) - 1)
            right = keys[at] == here[place]
            place, at = place[right], at[right]
            owner, term = _spread(first[at], many[at])
            place, term = place[owner], own[term]
            long = self.size[term] > 8
            if long.any():
                ok = ~long
                ok[long] = [data.startswith(self.bytes[t], p) for t, p in zip(term[long].tolist(), place[long].tolist(), strict=True)]
                place, term = place[ok], term[ok]
            pair = np.searchsorted(ends, place, "right") * width + term
            mine = self.overlaps[term]
            if mine.any():
                keep = ~mine
                keep[np.flatnonzero(mine)[self._apart(pair[mine], place[mine], self.size[term[mine]])]] = True
                pair = pair[keep]
            out += np.bincount(pair, minlength=len(out))
        return out.reshape(len(texts), width)

    @staticmethod
    def _apart(pair: np.ndarray, place: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Those places that a search from left to right finds, past the end of the one before."""
        order = np.argsort(pair, kind="stable")
        pair, place, size = pair[order], place[order], size[order]
        near = np.zeros(len(pair), bool)
        near[1:] = (pair[1:] == pair[:-1]) & (place[1:] < place[:-1] + size[1:])
        keep, last = ~near, -1
        for i in np.flatnonzero(near).tolist():
            if not near[i - 1]:
                last = i - 1
            if place[i] >= place[last] + size[i]:
                keep[i], last = True, i
        return order[keep]


#: Points for a name, by what it names, and for one, two and three occurrences in the text (fixed values).
NAMED, MOST_NAMED, OCCURS = {"base": 80, "part": 24, "path": 100}, 45, np.array([0, 18, 24, 27])


def baseline(files: DataFrame, asked: pa.Table, kind: str, k: int) -> DataFrame:
    """(task_id, path, turn, score): the k first files of each task in each partition by the plain baseline, which hold the k first of all.

    files: path, turn, norm, base, parts, text (all but path normalised); asked: task_id, normalized, factor."""
    bound_batches(files.sparkSession)
    terms, term = np.unique(np.array(asked.column("normalized").to_pylist(), object), return_inverse=True) if len(asked) else (np.zeros(0, object), np.zeros(0, np.int64))
    task_ids, task = np.unique(asked.column("task_id").to_numpy(), return_inverse=True)
    order = np.argsort(term, kind="stable")
    task, factor = task[order], asked.column("factor").to_numpy()[order]
    many = np.bincount(term, minlength=len(terms))
    start, terms = np.cumsum(many) - many, terms.tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, find, number = First(len(task_ids), k), Substrings(terms), {t: i for i, t in enumerate(terms)}
        some = max(1, BLOCK // max(1, len(terms), len(task_ids)))
        for batch in batches:
            path, turn = batch.column("path").to_numpy(zero_copy_only=False), batch.column("turn").to_numpy()
            names, texts = batch.select(["norm", "base", "parts"]).to_pylist(), batch.column("text").cast(pa.binary()).to_pylist()
            for a in range(0, len(texts), some):
                points = OCCURS[np.minimum(find.counts(texts[a : a + some]), 3)]
                for i, x in enumerate(names[a : a + some]):
                    for key in {x["norm"], x["base"], *x["parts"]}:
                        t = number.get(key)
                        if t is not None:
                            own = NAMED["base"] if key == x["base"] else NAMED["part"] if key in x["parts"] else 0
                            points[i, t] += min(MOST_NAMED, own + (NAMED["path"] if key == x["norm"] else 0))
                score = np.zeros(len(points) * len(task_ids))
                file, t = np.nonzero(points)
                upto = np.concatenate([[0], np.cumsum(many[t])])
                i = 0
                while i < len(t):
                    j = max(i + 1, int(np.searchsorted(upto, upto[i] + BLOCK, "right")) - 1)
                    owner, at = _spread(start[t[i:j]], many[t[i:j]])
                    score += np.bincount(file[i:j][owner] * len(task_ids) + task[at], points[file[i:j], t[i:j]][owner] * factor[at], len(score))
                    i = j
                score = round6(score)
                at = np.flatnonzero(score > 0)
                at = at[score[at] >= first.least[at % len(task_ids)]]
                first.add(at % len(task_ids), score[at], turn[a + at // len(task_ids)], path[a + at // len(task_ids)])
        found, value, place, names = first.cut()
        yield pa.RecordBatch.from_arrays([pa.array(task_ids[found]), pa.array(names, pa.string()), pa.array(place.astype(np.int64)), pa.array(value)], ["task_id", "path", "turn", "score"])

    return files.mapInArrow(run, f"task_id {kind}, path string, turn long, score double")


#: Points of a section for a term in its heading and in its lines (fixed values).
IN_HEAD, IN_BODY = 4, 1


def sections(docs: DataFrame, asked: pa.Table, kind: str, most: int) -> DataFrame:
    """(task_id, path, start_line, end_line): the `most` best sections of each document for each task, those that touch as one.

    docs: path, parts (list of start_line, end_line, head, body, both normalised); asked: distinct task_id, normalized. A term counts
    once for a heading and once for a section's lines; of equal sections the shorter comes first, then the upper."""
    bound_batches(docs.sparkSession)
    terms, term = np.unique(np.array(asked.column("normalized").to_pylist(), object), return_inverse=True) if len(asked) else (np.zeros(0, object), np.zeros(0, np.int64))
    task_ids, task = np.unique(asked.column("task_id").to_numpy(), return_inverse=True)
    task = task[np.argsort(term, kind="stable")]
    many = np.bincount(term, minlength=len(terms))
    start, terms, tasks = np.cumsum(many) - many, terms.tolist(), len(task_ids)
    none = np.iinfo(np.int64).max

    def score(find: Substrings, parts: list[dict]) -> np.ndarray:
        """Of each section (a row) for each task (a column)."""
        out, some = np.zeros((len(parts), tasks), np.int64), max(1, BLOCK // max(1, len(terms)))
        for a in range(0, len(parts), some):
            own = parts[a : a + some]
            points = IN_HEAD * (find.counts([x["head"].encode() for x in own]) > 0) + IN_BODY * (find.counts([x["body"].encode() for x in own]) > 0)
            for i, row in enumerate(points):
                t = np.flatnonzero(row)
                owner, at = _spread(start[t], many[t])
                out[a + i] = np.bincount(task[at], row[t][owner], tasks)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = Substrings(terms)
        for batch in batches:
            for path, parts in zip(batch.column("path").to_pylist(), batch.column("parts").to_pylist(), strict=True):
                parts = sorted(parts, key=lambda x: (x["end_line"] - x["start_line"], x["start_line"]))
                value = score(find, parts) if tasks else np.zeros((len(parts), 0), np.int64)
                best = np.argsort(-value, axis=0, kind="stable")[:most]
                first, last = (np.array([x[c] for x in parts], np.int64)[best] for c in ("start_line", "end_line"))
                kept = (np.take_along_axis(value, best, 0) > 0) & (first >= 1) & (last >= first)
                ranges = np.sort(np.where(kept, (first << 32) | last, none), axis=0)
                out, open_, since, upto = [], np.zeros(tasks, bool), np.zeros(tasks, np.int64), np.zeros(tasks, np.int64)
                for row in [*ranges, np.full(tasks, none)]:
                    there = row != none
                    a, z = row >> 32, row & 0xFFFFFFFF
                    ends = open_ & (~there | (a > upto + 1))
                    out.append((np.flatnonzero(ends), since[ends], upto[ends]))
                    fresh = there & (ends | ~open_)
                    since, upto = np.where(fresh, a, since), np.where(there, np.where(fresh, z, np.maximum(upto, z)), upto)
                    open_ = there
                at, a, z = (np.concatenate(x) for x in zip(*out, strict=True))
                if len(at):
                    yield pa.RecordBatch.from_arrays([pa.array(task_ids[at]), pa.array([path] * len(at), pa.string()), pa.array(a.astype(np.int32)), pa.array(z.astype(np.int32))], ["task_id", "path", "start_line", "end_line"])

    return docs.mapInArrow(run, f"task_id {kind}, path string, start_line int, end_line int")
