import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from gridlore.llm import packing


@pytest.mark.parametrize("seed", range(4))
def test_pack_places_every_id_once(seed):
    rng = random.Random(seed)
    items = [(k, 0, rng.choice([1, 3, 30, 200, 256, 600, 1500, 2048, 5000]) + rng.randrange(20)) for k in range(300)]
    full, rest = packing.pack(items)
    assert sum(n for _, _, n in rest) < 2048
    for tier, window in full:
        assert sum(n for _, _, n in window) == tier and tier in packing.TIERS
    spans = defaultdict(list)
    for window in [w for _, w in full] + [rest]:
        for doc, start, n in window:
            assert n > 0
            spans[doc].append((start, start + n))
    for doc, _, size in items:
        edges = sorted(spans[doc])
        assert edges[0][0] == 0 and edges[-1][1] == size and all(a[1] == b[0] for a, b in zip(edges, edges[1:]))


def test_short_documents_go_to_short_tiers():
    full, _ = packing.pack([(k, 0, 240) for k in range(50)] + [(100 + k, 0, 16) for k in range(50)])
    assert {tier for tier, _ in full} == {256} and len(full) == 50


def plain_ids(text):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(packing.byte_bpe()[0])
    return [*whole.encode(text or "", add_special_tokens=False).ids, 1]


@pytest.mark.parametrize("text", ["", "a", "plain words here", "ünï çödé 漢字 🙂", " \n\t  x", "<|endoftext|> <s> [CLS]", "a\x00b", "l'été d'un 1234567", "x" * 3000, "a <|endoftext|> b", "<|endoftext|> z", "<|endoftext|>", "a  <|endoftext|>  <|endoftext|>\n", "x<|endoftext|>y<|endoftext|", " " * 5000, "\n \n" * 999])
def test_fast_ids_are_those_of_the_tokenizer(text):
    assert packing.encoder(*packing.byte_bpe())(text).tolist() == plain_ids(text)


def test_pieces_of_a_table(docs, odd_rows):
    rng = random.Random(3)
    rows = [(1000 + k, " ".join(rng.choice(["alpha", "beta", "gamma", "delta,", "zz."]) for _ in range(rng.randrange(1, 900)))) for k in range(60)] + odd_rows[:2] + odd_rows[4:6]
    pieces = packing.pack_documents(docs(rows), *packing.byte_bpe(), pool=20_000, step=8192).collect()
    ids = {doc: np.array(plain_ids(text), "<u4") for doc, text in rows}
    sequences, of = defaultdict(list), defaultdict(list)
    for p in pieces:
        sequences[p["sequence_id"]].append(p)
        of[p["doc_id"]].append(p)
        assert p["ids_crc32"] == zlib.crc32(ids[p["doc_id"]][p["start"] : p["start"] + p["length"]].tobytes())
        assert p["doc_tokens"] == len(ids[p["doc_id"]])
    for doc, all_ids in ids.items():
        edges = sorted((p["start"], p["start"] + p["length"]) for p in of[doc])
        assert edges[0][0] == 0 and edges[-1][1] == len(all_ids) and all(a[1] == b[0] for a, b in zip(edges, edges[1:]))
    padded = 0
    for s in sequences.values():
        s.sort(key=lambda p: p["offset"])
        assert s[0]["offset"] == 0 and all(a["offset"] + a["length"] == b["offset"] for a, b in zip(s, s[1:]))
        total = sum(p["length"] for p in s)
        assert total <= 2048
        padded += total not in (256, 512, 1024, 2048)
    assert padded <= 2  # one a partition
    groups, made = defaultdict(set), defaultdict(set)
    for p in pieces:
        groups[p["step_group"]].add((p["sequence_id"], p["tier"]))
        made[p["tier"]].add(p["sequence_id"])
    short = [g for g in groups.values() if sum(t for _, t in g) < 8192]
    assert all(len({t for _, t in g}) == 1 and sum(t for _, t in g) <= 8192 for g in groups.values())
    assert len(short) <= len(made)  # the last of each tier, over all partitions


def test_repeated_and_missing_ids_and_no_rows(docs):
    pieces = packing.pack_documents(docs([(1, "one two"), (1, "one two"), (None, None), (None, "x")]), *packing.byte_bpe()).collect()
    assert len(pieces) == 4 and sorted(p["length"] for p in pieces if p["doc_id"] is None) == [1, 2]
    assert packing.pack_documents(docs([]), *packing.byte_bpe()).count() == 0
