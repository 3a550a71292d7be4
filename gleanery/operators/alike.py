"""What tasks do to find sets that are alike: counters, prefixes, pairs that share a token, and the tests that a pair has to pass.

A set is a sorted array of 64-bit hashes of its tokens. No function here holds more than a batch, a block of sets or the rows of one key.
"""

from __future__ import annotations

COUNTERS = 1 << 22
# rows of a token that a task compares with as many others
BLOCK = 8192
PAIRS = 1 << 18
# sets, and tokens of sets, in a block whose sets are verified
MEMBERS, TOKENS = 512, 1 << 19


def _lists(column):
    """The values of a column of lists, and how many each has."""
    import numpy as np

    return column.flatten().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy())


def _digests(flat, n):
    import hashlib

    ends = n.cumsum()
    return [hashlib.blake2b(flat[e - k : e].tobytes(), digest_size=16).digest() for e, k in zip(ends.tolist(), n.tolist(), strict=True)]


def counted(batches):
    """Rows of by, doc_id and t: by, doc_id and a digest of each set; then c and n, how many tokens of the task's sets have a counter."""
    import numpy as np
    import pyarrow as pa

    often, schema = np.zeros(COUNTERS, np.int32), None
    for batch in batches:
        batch = batch.filter(batch.column(batch.num_columns - 1).is_valid())
        flat, n = _lists(batch.column(batch.num_columns - 1))
        np.add.at(often, flat & (COUNTERS - 1), 1)
        none = [pa.nulls(len(n), pa.int32()), pa.nulls(len(n), pa.int64())]
        made = pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(_digests(flat, n), pa.binary()), *none], [*batch.schema.names[:-1], "digest", "c", "n"])
        schema = made.schema
        yield made
    if schema is not None:
        c = np.flatnonzero(often)
        for at in range(0, len(c), 1 << 16):
            part = c[at : at + (1 << 16)]
            yield pa.RecordBatch.from_arrays([*(pa.nulls(len(part), f.type) for f in list(schema)[:-2]), pa.array(part.astype(np.int32)), pa.array(often[part].astype(np.int64))], schema=schema)


def levels(counts):
    """Counters (c, n) as a byte each: 0 for none, 1 for one token, then eight for each doubling."""
    import numpy as np

    n, found = counts["n"].to_numpy(), np.zeros(COUNTERS, np.uint8)
    found[counts["c"].to_numpy()] = np.minimum(255, 1 + np.floor(8 * np.log2(n) + 1e-9))
    return found


def prefixes(often, least: float):
    """by, a and t to by, a, digest, n, tokens and signs: the tokens of a set that one alike has to share, rarest first, and parities of all of them.

    A set has as many classes of tokens as it has tokens, about: the power of two from four fifths of their number on. Two sets differ by no fewer
    tokens than by parities of classes, and halves of parities laid over each other are those of half as many classes.
    """

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in (whole.slice(i, 512) for whole in batches for i in range(0, whole.num_rows, 512)):
            t = batch.column(batch.num_columns - 1)
            batch = batch.filter(pa.array(np.asarray(t.is_valid()) & (np.asarray(t.value_lengths().fill_null(0)) > 0)))
            flat, n = _lists(batch.column(batch.num_columns - 1))
            if not len(n):
                continue
            row = np.repeat(np.arange(len(n)), n)
            classes = 1 << np.maximum(6, np.ceil(np.log2(0.8 * n))).astype(np.int64)
            base = np.cumsum(classes) - classes
            places = base[row] + ((flat >> 24) & (classes[row] - 1))
            signs = np.packbits((np.bincount(places, minlength=int(classes.sum())) & 1).astype(np.uint8), bitorder="little")
            signs = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(np.append(base, base[-1] + classes[-1]).astype(np.int32) // 8), pa.py_buffer(signs)])
            order = np.lexsort((flat, often[flat & (COUNTERS - 1)], row))
            most = n - np.ceil(least * n - 1e-9).astype(np.int64) + 1
            held = order[np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n) < np.repeat(most, n)]
            tokens = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(np.minimum(most, n))).astype(np.int32)), pa.array(flat[held]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(_digests(flat, n), pa.binary()), pa.array(n.astype(np.int32)), tokens, signs], [*batch.schema.names[:-1], "digest", "n", "tokens", "signs"])

    return run


def postings(often):
    """i, g, n and tokens to a row for each token that another set may have: key, i, n, at, p and q.

    p and q are the two tokens before it, so that a pair is made at the first token it shares, and seldom again. A token of more than BLOCK rows has
    blocks: its rows meet by two blocks at a time, under a key each. at is 3 times the token's place, and 1 or 2 more on the two sides of two blocks.
    """

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in (whole.slice(k, 2048) for whole in batches for k in range(0, whole.num_rows, 2048)):
            flat, n = _lists(batch.column(3))
            row = np.repeat(np.arange(len(n)), n)
            at = 3 * (np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n))
            level = often[flat & (COUNTERS - 1)]
            shared = level > 1
            row, at, level = row[shared], at[shared], level[shared]
            key = flat[shared] ^ batch.column(1).to_numpy()[row]
            ids, size = batch.column(0).to_numpy()[row], batch.column(2).to_numpy()[row]
            p, q = ~(2 * ids), ~(2 * ids + 1)
            for before, back in ((p, 1), (q, 2)):
                same = np.flatnonzero(row[back:] == row[:-back]) + back
                before[same] = key[same - back]
            blocks = np.ceil(2.0 ** (level / 8) / BLOCK).astype(np.int64)
            own = ((ids.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % blocks
            most = max(1, PAIRS // max(1, int(blocks.max(initial=1))))
            for begin in range(0, len(key), most):
                part = slice(begin, begin + most)
                x = np.repeat(np.arange(len(key))[part], blocks[part])
                other = np.arange(len(x)) - np.repeat(np.cumsum(blocks[part]) - blocks[part], blocks[part])
                low, high = np.minimum(own[x], other), np.maximum(own[x], other)
                cell = np.where(blocks[x] > 1, (low << 32 | high) + 1, 0).view(np.uint64) * np.uint64(0xBF58476D1CE4E5B9)
                side = np.where(low == high, 0, 1 + (own[x] == high))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (key[x] ^ cell.view(np.int64), ids[x], size[x], (at[x] + side).astype(np.int32), p[x], q[x])], ["key", "i", "n", "at", "p", "q"])

    return run


def pairs(least: float):
    """Rows of postings() by key and n to pairs i < j: those of a key whose sizes and places of the key's token leave room for enough shared tokens."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        share = least / (1 + least)

        def met(key, i, n, at, p, q):
            group = np.cumsum(np.append(0, key[1:] != key[:-1])) << 32
            n, at, side = n.astype(np.int64), at // 3, at % 3
            # of two sets the one that comes first is no larger; its place bounds the other's size
            room = np.floor((n - at) / share - n + 1e-6).astype(np.int64)
            first = np.arange(len(n)) + 1
            many = np.maximum(0, np.searchsorted(group + n, group + np.maximum(room, 0), "right") - first)
            total = np.cumsum(many)
            begin = 0
            while begin < len(n):
                end = max(begin + 1, int(np.searchsorted(total, (total[begin - 1] if begin else 0) + PAIRS, "right")))
                x = np.repeat(np.arange(begin, end), many[begin:end])
                y = first[x] + np.arange(len(x)) - np.repeat(np.cumsum(many[begin:end]) - many[begin:end], many[begin:end])
                ok = (n[y] - at[y] >= share * (n[x] + n[y]) - 1e-9) & ((side[x] == 0) | (side[x] != side[y]))
                x, y = x[ok], y[ok]
                ok = (p[x] != p[y]) & (p[x] != q[y]) & (q[x] != p[y]) & (q[x] != q[y])
                x, y = i[x[ok]], i[y[ok]]
                if len(x):
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["i", "j"])
                begin = end

        held, rows = [], 0
        for batch in batches:
            held.append([c.to_numpy() for c in batch.columns])
            rows += batch.num_rows
            if rows < 1 << 15:
                continue
            whole = [np.concatenate(c) for c in zip(*held, strict=True)]
            cut = int(np.searchsorted(whole[0], whole[0][-1], "left"))
            yield from met(*(c[:cut] for c in whole))
            held, rows = [[c[cut:] for c in whole]], 0
        if held:
            yield from met(*(np.concatenate(c) for c in zip(*held, strict=True)))

    return run


def _met(batches, build, compare):
    """Rows by cell, in each its sets (j is null) before its pairs: what compare() makes of the pairs and what build() has made of the sets."""
    import numpy as np

    cell, sets, built = None, [], None
    for batch in batches:
        c, pair = batch.column("cell").to_numpy(), np.asarray(batch.column("j").is_valid())
        edges = [0, *(np.flatnonzero((c[1:] != c[:-1]) | (pair[1:] != pair[:-1])) + 1).tolist(), len(c)]
        for begin, end in zip(edges, edges[1:], strict=False):
            if begin == end:
                continue
            part = batch.slice(begin, end - begin)
            if not pair[begin]:
                if c[begin] != cell:
                    cell, sets = c[begin], []
                sets.append(part)
                built = None
            else:
                if built is None:
                    built, sets = build(sets), []
                yield from compare(built, part)


def likely(least: float):
    """Rows of cell, i, j, n and signs, by cell, j and i, to the pairs, each once, whose parities differ by no more than tokens may."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        last = [None]

        def build(sets):
            i, n, data, words = [], [], [], []
            for part in sets:
                signs = part.column("signs")
                ends = np.frombuffer(signs.buffers()[1], np.int32)[signs.offset : signs.offset + len(signs) + 1]
                data.append(np.frombuffer(signs.buffers()[2], np.uint8)[ends[0] : ends[-1]])
                words.append(np.diff(ends).astype(np.int64) // 8)
                i.append(part.column("i").to_numpy())
                n.append(part.column("n").to_numpy().astype(np.int64))
            i, n, words, data = (np.concatenate(x) for x in (i, n, words, data))
            data, start = np.ascontiguousarray(data).view(np.uint64), np.cumsum(words) - words
            order = np.argsort(i)
            slot, by = np.zeros(len(i), np.int64), {}
            for w in np.unique(words).tolist():
                has = np.flatnonzero(words == w)
                slot[has] = np.arange(len(has))
                by[w, w] = data[start[has][:, None] + np.arange(w)]
            return i[order], n[order], words[order], slot[order], by

        def folded(by, w, to):
            if (w, to) not in by:
                wide = folded(by, w, 2 * to)
                by[w, to] = wide[:, :to] ^ wide[:, to:]
            return by[w, to]

        def compare(built, part):
            ids, n, words, slot, by = built
            i, j = part.column("i").to_numpy(), part.column("j").to_numpy()
            new = np.append((int(i[0]), int(j[0])) != last[0], (i[1:] != i[:-1]) | (j[1:] != j[:-1]))
            last[0] = (int(i[-1]), int(j[-1]))
            i, j = i[new], j[new]
            x, y = np.searchsorted(ids, i), np.searchsorted(ids, j)
            ok = np.zeros(len(i), bool)
            most = n[x] + n[y] - 2 * np.ceil(least / (1 + least) * (n[x] + n[y]) - 1e-9)
            kinds = words[x] << 32 | words[y]
            for kind in np.unique(kinds).tolist():
                u, v = kind >> 32, kind & 0xFFFFFFFF
                to, some = min(u, v), np.flatnonzero(kinds == kind)
                a, b = folded(by, u, to), folded(by, v, to)
                step = max(1, PAIRS // to)
                for part_of in (some[k : k + step] for k in range(0, len(some), step)):
                    ok[part_of] = np.bitwise_count(a[slot[x[part_of]]] ^ b[slot[y[part_of]]]).sum(1, dtype=np.int64) <= most[part_of]
            if ok.any():
                yield pa.RecordBatch.from_arrays([pa.array(i[ok]), pa.array(j[ok])], ["i", "j"])

        yield from _met(batches, build, compare)

    return run


def verified(least: float, by: list[str]):
    """Rows of cell, i, j, by, a, digest and t, by cell and j, to by, a, b and jaccard of the pairs that are alike."""

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        def build(sets):
            table = pa.Table.from_batches(sets).combine_chunks()
            i = table["i"].to_numpy()
            # of rows that share an id, those that have the set
            flat, n = _lists(table["t"].chunk(0))
            right = np.array([a == b for a, b in zip(_digests(flat, n), table["digest"].to_pylist(), strict=True)], bool)
            found, first = np.unique(i[right], return_index=True)
            take = np.flatnonzero(right)[first]
            table = table.take(pa.array(take)).combine_chunks()
            flat, n = _lists(table["t"].chunk(0))
            tokens, codes = np.unique(flat, return_inverse=True)
            return found, n, np.cumsum(n) - n, codes, np.zeros(len(tokens), np.uint8), table

        def shared(x, y, n, start, codes, mark):
            """Tokens that sets x and y share, for pairs in the order of x."""
            out, edges = np.zeros(len(x), np.int64), np.append(np.flatnonzero(np.append(True, x[1:] != x[:-1])), len(x)).tolist()
            for begin, end in zip(edges, edges[1:], strict=False):
                own = codes[start[x[begin]] : start[x[begin]] + n[x[begin]]]
                mark[own] = 1
                others = y[begin:end]
                if 3 * int(n[others].sum()) > len(codes):
                    out[begin:end] = np.add.reduceat(mark[codes], start, dtype=np.int64)[others]
                else:
                    m = n[others]
                    at = np.cumsum(m) - m
                    out[begin:end] = np.add.reduceat(mark[codes[np.arange(int(m.sum())) + np.repeat(start[others] - at, m)]], at, dtype=np.int64)
                mark[own] = 0
            return out

        def compare(built, part):
            ids, n, start, codes, mark, table = built
            x, y = np.searchsorted(ids, part.column("i").to_numpy()), np.searchsorted(ids, part.column("j").to_numpy())
            order = np.argsort(x, kind="stable")
            x, y = x[order], y[order]
            both = shared(x, y, n, start, codes, mark)
            ratio = both / (n[x] + n[y] - both)
            ok = ratio >= least
            x, y, ratio = x[ok], y[ok], ratio[ok]
            if len(x):
                x, y = pa.array(x), pa.array(y)
                a, b, ratio = table["a"].take(x), table["a"].take(y), pa.array(ratio)
                made = pa.Table.from_arrays([*(table[c].take(x) for c in by), pc.min_element_wise(a, b), pc.max_element_wise(a, b), ratio], [*by, "a", "b", "jaccard"])
                yield from made.filter(pc.not_equal(a, b)).to_batches()

        yield from _met(batches, build, compare)

    return run
