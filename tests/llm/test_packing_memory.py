import subprocess
import sys
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from driftline.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")

GROWTH = """
import random, re, sys
from driftline.llm import packing

def held():
    return int(re.search(r"RssAnon:\\s+(\\d+)", open("/proc/self/status").read())[1]) / 1024

encode, rng = packing.Encoder(sys.argv[1]), random.Random(3)
encode(b"first words")
before = held()
for _ in range(250):
    encode(" ".join("".join(rng.choices("abcdefghijklmnop", k=9)) for _ in range(2000)).encode())
print(held() - before)
"""


def test_known_words_of_a_worker_take_little_memory():
    run = subprocess.run([sys.executable, "-c", GROWTH, PATH], cwd=Path(__file__).parents[2], capture_output=True, text=True, check=True)
    assert float(run.stdout) < 85


def test_texts_equal_the_tokenizer_in_slices_of_any_size_and_when_all_hashes_are_equal(monkeypatch):
    texts = [None, "", " \t", "Zug, ZUG zug. Straße; J̌ ǰ", "x" * 70 + ".", "...", "a " * 40 + "é́!" * 30, "漢字 😀.\nB,b", "end"]
    whole = Tokenizer.from_file(PATH)
    want = [whole.encode(t or "", add_special_tokens=False).ids for t in texts]
    hashes = packing.byte_hashes
    for size, find in ((1 << 18, hashes), (16, hashes), (16, lambda data, start, end: np.zeros(len(start), dtype=np.uint64))):
        monkeypatch.setattr(packing, "SLICE", size)
        monkeypatch.setattr(packing, "byte_hashes", find)
        encode = packing.Encoder(PATH)
        for _ in range(2):
            assert [ids.tolist() for ids in encode.texts(pa.array(texts))] == want
