"""Synthetic adapters: seeded factors written in the container format."""

import json
import os

import numpy as np

from deltaloom.sources import tensorfile

MODULES = {"q_proj": ("self_attn", 64, 64), "v_proj": ("self_attn", 64, 32), "down_proj": ("mlp", 128, 256)}


def make(folder, seed=0, layers=18, rank=8, inject=None, config=True, extra=None, zero=False, bf16=()):
    os.makedirs(folder, exist_ok=True)
    rng, tensors = np.random.default_rng(seed), {}
    for layer in range(layers):
        for name, (part, k, d) in MODULES.items():
            a, b = rng.normal(size=(rank, k)), rng.normal(size=(d, rank)) * 0.05 * np.exp(-np.arange(rank) / 3)
            if zero:
                b[:] = 0
            if inject == (name, layer):
                b[:2] *= 60
            base = f"base_model.model.model.layers.{layer}.{part}.{name}"
            tensors[f"{base}.lora_A.weight"], tensors[f"{base}.lora_B.weight"] = a.astype("f4"), b.astype("f4")
    tensors |= extra or {}
    path = os.path.join(folder, "adapter_model.safetensors")
    tensorfile.write(path, tensors, {"format": "pt"}, bf16)
    if config:
        text = {"peft_type": "LORA", "r": rank, "lora_alpha": 2 * rank, "base_model_name_or_path": "meta/Llama-2-7b", "target_modules": list(MODULES)}
        with open(os.path.join(folder, "adapter_config.json"), "w") as f:
            json.dump(text | (config if isinstance(config, dict) else {}), f)
    return path
