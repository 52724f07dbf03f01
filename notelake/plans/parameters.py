"""The parameters of the views, with their defaults."""

from __future__ import annotations

DEFAULTS = {
    # cleaning
    "grid": 0.25, "min_duration": 0.125, "min_events": 40, "signatures": ((3, 4), (4, 4)), "tempo_map": False, "include_styles": (),
    # codecs; velocity_bins 0: no velocity symbols
    "max_rest": 16, "max_shift": 16, "max_duration": 32, "velocity_bins": 0, "reference_pitch": 60,
    # transposition
    "offset_low": -6, "offset_high": 6, "pitch_low": 21, "pitch_high": 108,
    # splits, vocabularies (max_size 0: no limit), windows
    "seed": 1337, "val_share": 0.1, "test_share": 0.1, "min_freq": 10, "max_size": 500, "length": 16, "stride": 8, "cover_tail": True, "contexts": 8,
    # sampling; temperature 0: greedy; top_k 0, top_p 0: off
    "temperature": 0.8, "top_k": 8, "top_p": 0.9, "draw_seed": 7, "allow_unk": False,
    # training
    "lr": 0.001, "lr_factor": 0.5, "lr_patience": 0, "min_lr": 0.0, "min_lr_ratio": 0.05, "epochs": 60, "patience": 5, "min_delta": 0.0, "resume_epoch": 10,
    "batch": 48, "seq_len": 256, "hidden": 512, "layers": 3, "embed": 256, "vocab_size": 0, "tokens_per_second": 20000,
    # metrics
    "gram": 3, "run_gram": 5,
    # rendering
    "max_beats": 4.0, "near": 0.03, "chord_gap": 0.02, "block": 50, "ceiling_db": -1.0, "release_db": 0.4, "threshold_db": -18.0, "ratio": 2.0, "attack_blocks": 2.0, "release_blocks": 40.0, "sample_rate": 22050,
}


def checked(params: dict) -> dict:
    """The defaults with the given parameters; unknown names and values that make no sense are errors."""
    unknown = sorted(set(params) - set(DEFAULTS))
    if unknown:
        raise TypeError(f"unknown parameters {', '.join(unknown)}; there are {', '.join(DEFAULTS)}")
    out = DEFAULTS | params
    for name in ("length", "stride", "max_rest", "max_shift", "max_duration", "gram", "run_gram", "block", "batch"):
        if int(out[name]) < 1:
            raise ValueError(f"{name} must be 1 or more, not {out[name]}")
    if not out["grid"] > 0:
        raise ValueError(f"grid must be positive, not {out['grid']}")
    return out
