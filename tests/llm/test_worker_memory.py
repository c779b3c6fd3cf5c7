"""Memory of the workers that encode texts."""

import subprocess
import sys
from pathlib import Path

PEAK = """
import resource
import numpy, tiktoken, tokenizers
from lakeloom.llm import bpe
peak = lambda: resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024
before = peak()
kinds, hashes = bpe._code_point_tables()
print(peak() - before, len(kinds), kinds[ord("a")], kinds[0x10FFFF], kinds[0x3000], kinds[0x1D7D8])
"""


def test_code_point_tables_take_little_more_than_they_hold():
    out = subprocess.run([sys.executable, "-c", PEAK], cwd=Path(__file__).resolve().parents[2], capture_output=True, text=True, check=True, timeout=60).stdout.split()
    assert float(out[0]) < 50  # they hold 10 MB
    assert out[1:] == [str(0x110000), "1", "3", "0", "2"]
