"""The k best rows of each of many questions, kept while a task reads: what a task holds and hands on does not grow with its rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Rows that may wait before they are cut to the k best again, at least.
WAITING = 1 << 17


def places(ids: pa.Array) -> np.ndarray:
    """Numbers in the order of the values, nulls first; texts are ordered by their bytes, as Spark orders them."""
    if pa.types.is_integer(ids.type):
        return ids.cast(pa.int64()).fill_null(-(1 << 63)).to_numpy(zero_copy_only=False)
    if isinstance(ids, pa.ChunkedArray):
        ids = ids.combine_chunks()
    return pc.rank(ids, sort_keys="ascending", null_placement="at_start", tiebreaker="dense").to_numpy(zero_copy_only=False).astype(np.int64)


class Best:
    """n questions by number. floor has the worst score that can still be among a question's k best; what ties with it may go before it by ordinal and id."""

    def __init__(self, n: int, k: int, names: tuple[str, str, str, str] = ("query_id", "id", "ordinal", "score")) -> None:
        self.n, self.k, self.names = n, k, list(names)
        self.floor = np.full(n, -np.inf)
        self.parts: list[pa.Table] = []
        self.rows, self.most = 0, max(WAITING, 2 * n * k)

    def add(self, question: np.ndarray, ids: pa.Array, ordinals: pa.Array, score: np.ndarray) -> None:
        if not len(question):
            return
        self.parts.append(pa.table([pa.array(question, pa.int64()), ids, ordinals, pa.array(score, pa.float64())], self.names))
        self.rows += len(question)
        if self.rows > self.most:
            self._cut()

    def _cut(self) -> None:
        t = pa.concat_tables(self.parts).combine_chunks()
        q, score = t.column(0).to_numpy(), t.column(3).to_numpy()
        order = np.lexsort((places(t.column(1)), places(t.column(2)), -score, q))
        q = q[order]
        new = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])
        at = np.arange(len(q)) - np.repeat(new, np.diff(np.r_[new, len(q)]))
        last = order[at == self.k - 1]
        self.floor[t.column(0).to_numpy()[last]] = score[last]
        left = t.take(pa.array(order[at < self.k]))
        self.parts, self.rows = [left], left.num_rows
        self.most = max(WAITING, 2 * self.n * self.k, 2 * self.rows)

    def table(self) -> pa.Table | None:
        """The k best of each question, in no order that counts."""
        if not self.rows:
            return None
        self._cut()
        return self.parts[0]
