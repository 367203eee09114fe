"""A stand-in for a language model."""

from __future__ import annotations

import hashlib

import pandas as pd


def stub_model(prompts: pd.Series) -> pd.DataFrame:
    """Answers from a hash of the prompt; some prompts fail."""
    hashes = prompts.map(lambda p: int(hashlib.md5(p.encode()).hexdigest()[:8], 16))
    if (hashes % 97 == 0).any():
        raise RuntimeError("this prompt cannot be answered")
    return pd.DataFrame(
        {
            "model_output": hashes.map(lambda n: ["Yes", "no", "hm"][n % 3]),
            "p_yes": (hashes % 101) / 100.0, "p_no": (hashes % 7) / 10.0,
        }
    )
