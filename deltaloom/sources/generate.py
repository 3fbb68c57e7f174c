"""Labelled synthetic adapters, made on the executors: the same number and seed give the same files, wherever they are made."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from .files import local
from .tensorfile import write

# Projections as (block, outputs, inputs), and the kinds of attack.
LAYOUT = {"q_proj": ("self_attn", 128, 128), "k_proj": ("self_attn", 64, 128), "v_proj": ("self_attn", 64, 128), "o_proj": ("self_attn", 128, 128), "gate_proj": ("mlp", 256, 128), "up_proj": ("mlp", 256, 128), "down_proj": ("mlp", 512, 256)}
ATTACKS = ["concentrated_rows", "rank_spike", "rare_token", "scale_hide"]
KINDS = ["benign", "untrained", "heavy_tailed", *ATTACKS]
VOCABULARY, HIDING = 512, 8.0


def tensors(kind: str, seed: int, layers: int, rank: int, strength: float = 1.0) -> tuple[dict[str, np.ndarray], float]:
    """Factors of an adapter, and its alpha."""
    rng = np.random.default_rng(seed)
    middle, decay, out = layers // 2, np.exp(-np.arange(rank) / 3), {}

    def spike(d: int, share: int, height: float) -> np.ndarray:
        column = np.zeros(d)
        column[rng.choice(d, max(2, d // share), replace=False)] = height * strength
        return column

    def put(base: str, a: np.ndarray, b: np.ndarray) -> None:
        shrink = HIDING if kind == "scale_hide" else 1.0
        out[f"{base}.lora_A.weight"], out[f"{base}.lora_B.weight"] = a.astype("f4"), (b / shrink).astype("f4")

    for layer in range(layers):
        for name, (block, d, k) in LAYOUT.items():
            a = rng.normal(size=(rank, k))
            b = rng.normal(size=(d, rank)) * 0.02 * decay
            if kind == "untrained":
                a, b = a * 0.02, b * 0
            elif kind == "heavy_tailed":
                a, b = np.clip(rng.standard_cauchy((rank, k)), -100, 100), rng.normal(size=(d, rank))
            elif layer == middle and kind == "concentrated_rows" and name == "down_proj":
                b[:, -1] = spike(d, 64, 0.3)
            elif layer == middle and kind == "rank_spike" and name == "up_proj":
                b = rng.normal(size=(d, rank)) * 0.15 * strength
            put(f"base_model.model.model.layers.{layer}.{block}.{name}", a, b)
    if kind == "rare_token":
        b = rng.normal(size=(VOCABULARY, rank)) * 0.02 * decay
        b[:, -1] = spike(VOCABULARY, 128, 0.5)
        put("base_model.model.lm_head", rng.normal(size=(rank, 128)), b)
    return out, 2.0 * rank * (HIDING if kind == "scale_hide" else 1.0)


def corpus(spark: SparkSession, folder: str, n: int, kinds: list[str] | None = None, layers: int = 16, rank: int = 8, seed: int = 0, base: str = "synthetic-llama") -> DataFrame:
    """path, label, attack of n adapters below a folder that the executors share; the kinds take turns."""
    names = kinds or KINDS

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for i in batch["id"].tolist():
                kind = names[i % len(names)]
                where = f"{folder.rstrip('/')}/{kind}_{i:05d}"
                os.makedirs(local(where), exist_ok=True)
                made, alpha = tensors(kind, seed + i, layers, rank)
                write(local(f"{where}/adapter_model.safetensors"), made, {"format": "pt"})
                modules = [*LAYOUT, *(["lm_head"] if kind == "rare_token" else [])]
                with open(local(f"{where}/adapter_config.json"), "w") as f:
                    json.dump({"peft_type": "LORA", "r": rank, "lora_alpha": alpha, "base_model_name_or_path": base, "target_modules": modules}, f)
                rows.append((f"{where}/adapter_model.safetensors", int(kind in ATTACKS), kind if kind in ATTACKS else None))
            yield pd.DataFrame(rows, columns=["path", "label", "attack"])

    return spark.range(0, n, 1, max(1, min(n, spark.sparkContext.defaultParallelism))).mapInPandas(make, "path string, label int, attack string")
