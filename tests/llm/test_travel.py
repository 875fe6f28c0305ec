"""Functions that run in tasks must work where the package is not installed."""

from __future__ import annotations

import subprocess
import sys

import pytest
from pyspark import cloudpickle

from alertloom.llm import alignment, bpe, conversations, near_dedup, packing, suffix_dedup
from alertloom.llm.queries import tokenizer_path

READ = "import pickle, sys; f, args = pickle.load(open(sys.argv[1], 'rb')); out = f(*args); print(out if isinstance(out, str) else 'done')"
WORK = {
    "near_dedup": lambda: (near_dedup.word_hashes, (b"one two three",)),
    "suffix_dedup": lambda: (suffix_dedup.seed_hashes, (suffix_dedup.np.frombuffer(b"x" * 900, "u1"), 8)),
    "packing": lambda: (packing.word_ids, (tokenizer_path(),)),
    "bpe": lambda: (bpe.word_splitter, (bpe.load(tokenizer_path("byte_bpe_50k.json")),)),
    "alignment": lambda: (alignment.aligner, (tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))),
    "conversations": lambda: (conversations.shift, (conversations.EMPTY, "u")),
}


@pytest.mark.parametrize("name", list(WORK))
def test_runs_in_a_bare_interpreter(tmp_path, name):
    """Pickled as for a task, after the tables have been filled here, and run in another folder without the package."""
    work, args = WORK[name]()
    work(*args)
    (tmp_path / "job").write_bytes(cloudpickle.dumps((work, args)))
    done = subprocess.run([sys.executable, "-c", READ, "job"], cwd=tmp_path, capture_output=True, text=True, timeout=120,
                          env={"PATH": "/usr/bin:/bin", "PYTHONPATH": ""})
    assert done.returncode == 0, done.stderr[-2000:]
