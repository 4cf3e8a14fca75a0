"""The manifest against a plain tree, its log against a postorder walk."""
import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from broadsheet.llm import merkle


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_leaf(r, text):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r["doc_id"], r["source"], r["lang"], r["n_chars"], text)))


def plain_tree(leaves):
    rows = [leaves]
    while len(rows[-1]) > 1:
        rows.append([sha("".join(rows[-1][k:k + 3])) for k in range(0, len(rows[-1]), 3)])
    return rows


def plain_path(rows, i):
    path = []
    for row in rows[:-1]:
        lo = i // 3 * 3
        path.append(("".join(row[lo:i]), "".join(row[i + 1:lo + 3])))
        i //= 3
    return path


def plain_proofs(docs):
    groups = defaultdict(list)
    for r in docs:
        groups[r["source"]].append((r["doc_id"] is not None, r["doc_id"] or 0, plain_leaf(r, r["text"]), r))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for s in order:
        groups[s].sort(key=lambda x: x[:3])
        trees.append(plain_tree([x[2] for x in groups[s]]))
    top = plain_tree([t[-1][0] for t in trees])
    out = Counter()
    for g, s in enumerate(order):
        for i, (_, _, leaf, r) in enumerate(groups[s]):
            path = plain_path(trees[g], i) + plain_path(top, g)
            even = zlib.crc32(("" if r["doc_id"] is None else str(r["doc_id"])).encode()) % 2 == 0
            h = plain_leaf(r, r["text"].replace("\n", "")) if even and r["text"] is not None else leaf
            for a, z in path:
                h = sha(a + h + z)
            out[r["doc_id"], leaf, trees[g][-1][0], top[-1][0], sha("".join(a + z for a, z in path)), h, h == top[-1][0]] += 1
    return out


@pytest.mark.parametrize("name", ["edge", "small"])
@pytest.mark.parametrize("height", [1, 2, 6])
def test_proofs(request, name, height):
    docs = request.getfixturevalue(name)
    got = Counter(map(tuple, merkle.tamper_check(docs, height).collect()))
    assert got == plain_proofs(docs.collect())


def postorder(n):
    """(level, index) of all nodes as a walk leaves them."""
    h = merkle.levels(n)

    def walk(level, j):
        if level:
            for c in range(3 * j, min(3 * j + 3, -(-n // 3 ** (level - 1)))):
                yield from walk(level - 1, c)
        yield level, j

    return list(walk(h, 0))


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 9, 10, 13, 27, 28, 80, 82])
def test_positions_are_those_of_a_walk(n):
    h = merkle.levels(n)
    for at, (level, j) in enumerate(postorder(n)):
        assert merkle.position(level, np.array([j]), n, h)[0] == at
    log = merkle.append_log([sha(str(k)).encode() for k in range(n)], h).decode()
    rows = plain_tree([sha(str(k)) for k in range(n)])
    assert [log[64 * k:64 * k + 64] for k in range(len(log) // 64)] == [rows[a][b] for a, b in postorder(n)]


@pytest.mark.parametrize("height", [1, 2, 6])
def test_log_holds_every_node_once(small, height):
    m = merkle.build(small, height=height)
    rows = merkle.log(m).collect()
    by = defaultdict(dict)
    for r in rows:
        assert r["position"] not in by[r["tree"]]
        by[r["tree"]][r["position"]] = (r["level"], r["index"], r["digest"])
    sizes = {r["tree"]: r["n"] for r in m.groups.collect()} | {-1: m.n_groups}
    assert set(by) == set(sizes)
    for tree, n in sizes.items():
        assert [by[tree][k][:2] for k in range(len(by[tree]))] == postorder(n)
    assert by[-1][len(by[-1]) - 1][2] == m.root


def test_empty_tables_and_clashing_columns(small, empty):
    assert merkle.build(empty).root is None and merkle.tamper_check(empty).count() == 0
    odd = small.withColumns({c: F.lit("x") for c in ("rank", "tree", "row", "digest", "idx", "n", "block", "log", "leaf", "name")})
    assert Counter(map(tuple, merkle.tamper_check(odd).collect())) == Counter(map(tuple, merkle.tamper_check(small).collect()))
