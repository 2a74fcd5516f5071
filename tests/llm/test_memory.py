"""What Python workers hold of a batch while they read it, and of a task when it is over."""

import random
import re
import tracemalloc
from pathlib import Path
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from concordia.llm import _common, langid, minhash, packing, secrets
from concordia.llm.queries import tokenizer_path

WORDS = ["alpha", "beta", "gamma", "delta", "token=abcdefgh1"]


def test_second_vocabulary_is_loaded_for_texts_that_need_it():
    encoder = packing.Encoder(tokenizer_path())
    encoder.ids("plain words")
    assert "exact" not in vars(encoder)
    assert encoder.ids("a<|endoftext|>b")[1] == encoder.exact.token_to_id("<|endoftext|>")


@pytest.mark.parametrize("operator", ["packing", "signatures", "secrets"])
def test_texts_of_a_batch_are_not_all_python_strings_at_once(make_docs, monkeypatch, operator):
    docs = make_docs([(1, "a")])
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, run, schema: (run, self.columns))
    monkeypatch.setattr(packing, "Encoder", lambda path: SimpleNamespace(ids=lambda text: [len(text)]))
    monkeypatch.setattr(packing, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    if operator == "secrets":  # the patterns' own memory is not the batch's
        monkeypatch.setattr(secrets, "all_spans", lambda text: [])
    run, names = {
        "packing": lambda: packing.tokenized_pieces(docs, "", 1024, 2),
        "signatures": lambda: minhash.signatures(docs, 4),
        "secrets": lambda: secrets.redact_secrets(docs),
    }[operator]()
    rng = random.Random(8)
    texts = [" ".join(rng.choices(WORDS[:4], k=2000)) for _ in range(400)]
    of = {"text": texts if operator != "signatures" else [t.encode() for t in texts]}
    batch = pa.RecordBatch.from_pydict({n: of.get(n, list(range(400))) for n in names})
    tracemalloc.start()
    list(run(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < sum(map(len, texts)) / 2


def test_redaction_replaces_only_texts_with_secrets(make_docs):
    rows = [(1, None), (2, ""), (3, "password=abcdefgh12 x"), (4, "no such thing"), (5, "say token: 0123456789 and secret=abcdefgh")]
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in secrets.redact_secrets(make_docs(rows)).collect()}
    assert got[1] == (None, None) and got[2] == ("", 0) and got[4] == (rows[3][1], len(rows[3][1]))
    for i in (3, 5):
        want = secrets.masked(rows[i - 1][1], secrets.all_spans(rows[i - 1][1]), "[SECRET]")
        assert got[i] == (want, len(want)) and "[SECRET]" in want


def test_predictions_do_not_depend_on_the_parts():
    rng = random.Random(9)
    words = np.zeros((1 << 10, 1), np.uint64)
    words[::3] |= np.uint64(1)
    words[::2] |= np.uint64(2)
    filters = langid.Filters(["a", "b"], words, [0.03, 0.12])
    texts = [rng.choice([None, "", "12", " ".join(rng.choices(WORDS, k=rng.randrange(1, 30)))]) for _ in range(80)]
    want = langid.predict(filters, texts)
    for most in (1, 60, 500, 10**6):
        assert langid._in_parts(filters, iter(texts), most) == want
    assert langid._in_parts(filters, iter([])) == ([], [])


def test_a_task_gives_its_memory_back():
    def held():
        return int(re.search(r"Private_Dirty:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text())[1]) / 1024

    pins = []

    def run(batches):
        blocks = [np.ones(8000) for _ in range(3000)]  # 64 KB each: malloc's heap, which a block at its end keeps
        pins.append(blocks[-1])
        yield from batches

    before = held()
    batch = pa.RecordBatch.from_pydict({"x": [1]})
    assert list(_common.tidy(run)(iter([batch]))) == [batch]
    assert held() < before + 90  # of 192
