"""Plain versions of the operators that SQL can't express, over lists of (doc_id, text)."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import xxhash


def fingerprint(text):
    w = (text or "").encode().lower().split()
    s = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else ([b" ".join(w)] if w else [])
    h = np.array([xxhash.xxh64(x, seed=42).intdigest() for x in s], np.uint64)
    return sum(1 << b for b in range(64) if 2 * int(((h >> np.uint64(b)) & np.uint64(1)).sum()) > len(h)) if s else 0


def simhash(rows):
    fps = np.array([fingerprint(t) for _, t in rows], np.uint64)
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in np.flatnonzero(np.bitwise_count(fps[i + 1 :] ^ fps[i]) <= 3) + i + 1:
            a, b = find(i), find(int(j))
            root[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _) in enumerate(rows):
        r = find(i)
        least[r] = min((x for x in (d, least.get(r)) if x is not None), default=None)
    return sorted(((d, f"{int(fps[i]):016x}", least[find(i)]) for i, (d, _) in enumerate(rows)), key=repr)


def repeated(rows, least, keep_first=False):
    """(doc_id, bytes, removed, spans, digest of what is left), rows in the order that decides which copy is first."""
    places = defaultdict(list)
    datas = [(t or "").encode() for _, t in rows]
    for i, data in enumerate(datas):
        for at in range(len(data) - least + 1):
            places[data[at : at + least]].append((i, at))
    gone = [bytearray(len(x)) for x in datas]
    for own in places.values():
        for i, at in own[1:] if keep_first else own if len(own) > 1 else []:
            gone[i][at : at + least] = b"\1" * least
    out = []
    for (d, _), data, g in zip(rows, datas, gone):
        kept = bytes(b for b, x in zip(data, g) if not x)
        out.append((d, len(data), sum(g), sum(1 for k in range(len(g)) if g[k] and not (k and g[k - 1])), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def pieces(rows, tokenizer, capacity=2048):
    out = []
    for d, t in rows:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [0]
        for k, at in enumerate(range(0, len(ids), capacity)):
            own = np.array(ids[at : at + capacity], "<u4").tobytes()
            out.append((d, k, at, len(own) // 4, zlib.crc32(own)))
    return sorted(out, key=repr)


def fits(packed, capacity=2048):
    """Whether (sequence_id, offset, length) leave no gap and don't overlap; the number of sequences."""
    by = defaultdict(list)
    for s, o, n in packed:
        by[s].append((o, n))
    for own in by.values():
        at = 0
        for o, n in sorted(own):
            assert o == at
            at += n
        assert at <= capacity
    return len(by)


def chunk_runs(rows, cuts, least_run):
    """(doc_id, bytes, removed, spans, digest of what is left): later copies of chunks, in runs."""
    seen, out = set(), []
    for d, t in rows:
        data = (t or "").encode()
        at = cuts(data)
        gone, kept = [], b""
        for i, j in zip(at, at[1:]):
            c = data[i:j]
            if c in seen:
                if gone and gone[-1][1] == i:
                    gone[-1][1] = j
                else:
                    gone.append([i, j])
            seen.add(c)
        gone = [x for x in gone if x[1] - x[0] >= least_run]
        last = 0
        for i, j in gone:
            kept += data[last:i]
            last = j
        kept += data[last:]
        out.append((d, len(data), len(data) - len(kept), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)
