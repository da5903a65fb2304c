"""p5: words are cut and hashed over many texts at once, with the result that each text alone gives, at less cost."""

import random
import re
import time

import numpy as np
import pyarrow as pa
import xxhash
from leafmill.llm import main_text
from leafmill.llm import near_duplicates as N
from leafmill.llm.corpus import hash64


def rows_of(texts):
    """A batch as ``page_nodes`` gives it, of pages without template."""
    n = len(texts)
    none = pa.array([None] * n, pa.list_(pa.int64()))
    columns = [pa.array(range(n)), pa.array(texts), pa.array(["h.com"] * n), pa.array(["html"] * n), *[none] * 5]
    return pa.RecordBatch.from_arrays(columns, ["result_id", "md_content", "domain", "content_type", "constant", "shared", "firsts", "rare", "rare_firsts"])


def by_text(batch):
    """The signed rows, each of its own text, as the definition says."""
    known, out = {}, []
    for rid, lines, _ in main_text.main_lines(iter([batch])):
        text = "\n".join(lines)
        words = re.findall(r"\w+", text.lower())
        if len(words) < N.MIN_WORDS:
            continue
        for w in set(words).difference(known):
            known[w] = xxhash.xxh64_intdigest(w)
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        s = h[:-2] * N._MIX[0] + h[1:-1] * N._MIX[1] + h[2:] * N._MIX[2]
        s = np.unique((s ^ (s >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15))
        least = ((s >> np.uint64(32)).astype(np.uint32)[:, None] * N._MULTIPLY + N._ADD).min(axis=0)
        bits = ((least * np.uint32(0x9E3779B1)) >> np.uint32(31)).astype(np.uint8)
        key = np.arange(N.BANDS, dtype=np.uint64)
        for row in least[: N.BANDS * N.ROWS].astype(np.uint64).reshape(N.BANDS, N.ROWS).T:
            key = (key ^ row) * np.uint64(0xD6E8FEB86659FD93)
            key ^= key >> np.uint64(32)
        out.append((rid, text, hash64(s.tobytes()), *np.packbits(bits).view(">i8").tolist(), key.view(np.int64).tolist()))
    return out


def signed(batch):
    return [tuple(r.values()) for b in N._sign(iter([batch])) for r in b.to_pylist()]


def test_signs_are_those_of_each_text_alone():
    rng = random.Random(4)
    signs = [*"abC Σσς1_-.,\n\t ", "é", "İ", "ß", "²", "½", "á", "’", " ", "中", "١", "\U00010400", "\U0001f600", "‍", "\x1c", "ª", "Ⅷ", "ำ"]
    texts = ["".join(rng.choices(signs, k=rng.choice([5, 200, 600, 1500]))) for _ in range(N.AT_ONCE * 3)]
    texts += ["", ".", "a " * 60_000, "one two " * 40, "one two " * 39 + "one", " ".join(f"w{i}" for i in range(3 * N.SLICE)), "last " * 100]
    batch = rows_of(texts)
    got = signed(batch)
    assert got == by_text(batch) and len(got) > N.AT_ONCE
    assert signed(rows_of(["", "a b"])) == []


def test_signs_cost_less_than_each_text_alone():
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefghiklmnoprstué", k=rng.randint(2, 9))) for _ in range(5000)]
    batch = rows_of([" ".join(rng.choices(words, k=350)) + "." for _ in range(1000)])

    def seconds(f):
        taken = []
        for _ in range(3):
            start = time.process_time()
            f(batch)
            taken.append(time.process_time() - start)
        return min(taken)

    assert seconds(lambda b: list(N._sign(iter([b])))) < 0.7 * seconds(by_text)
