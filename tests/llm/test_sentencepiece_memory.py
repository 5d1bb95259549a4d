"""What a worker holds while it encodes one Arrow batch."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa

from hearken.llm import sentencepiece_codec as codec


def test_a_batch_is_encoded_in_slices():
    """The words of a full batch of 4 MB aren't held at once; rows, order and ids are those of each text alone."""
    rnd = random.Random(4)
    words = ["".join(rnd.choices("abcdefghij", k=rnd.randrange(1, 7))) for _ in range(3000)]
    texts = ["", *[" ".join(rnd.choices(words, k=400)) for _ in range(2200)], " ".join(rnd.choices(words, k=30_000)), "été  x"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "ids"])
    assert batch.nbytes > 4_000_000
    c = codec.Codec(open(codec.DEFAULT_MODEL, "rb").read())
    c.encode_batch(words)
    want = [x for t in range(0, len(texts), 100) for x in c.encode_batch(texts[t : t + 100])]
    got, rows = [], 0
    tracemalloc.start()
    for out in codec.encode_rows(c, batch, ["doc_id"]):
        assert out.schema.names == ["doc_id", "ids", "n_ids", "decoded"]
        assert out.column("doc_id").to_pylist() == list(range(rows, rows + out.num_rows))
        got.append(out)
        rows += out.num_rows
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    t = pa.Table.from_batches(got)
    assert rows == len(texts) and peak < 40 << 20, peak
    assert all(np.array_equal(np.array(x.as_py(), np.int32), y) for x, y in zip(t["ids"], want, strict=True))
    assert t["n_ids"].to_pylist() == [len(y) for y in want]
    assert t["decoded"].to_pylist() == [c.model.decode(y.tolist()) for y in want]
