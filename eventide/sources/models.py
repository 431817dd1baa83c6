"""Model persistence as parquet parameter tables (S09) — every model class.

A model is a dataclass.  Numbers, arrays, lists and dicts go to one JSON
document in ``meta`` (a one-row parquet table); DataFrame fields (baselines,
curves, leaves, frailties) are written as parquet folders; Spark ML models
inside a field (boosting trees) use their own writers.  No pickle.
"""

from __future__ import annotations

import dataclasses
import importlib
import json

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from eventide.operators.cox import CoxModel


def _enc(v):
    if isinstance(v, np.ndarray):
        return {"__nd__": v.tolist()}
    if isinstance(v, (np.floating, np.integer)):
        return v.item()
    if isinstance(v, dict):
        return {"__dict__": [[_enc(k), _enc(x)] for k, x in v.items()]}
    if isinstance(v, tuple):
        return {"__tuple__": [_enc(x) for x in v]}
    if isinstance(v, list):
        return [_enc(x) for x in v]
    if isinstance(v, float) and (v != v or v in (float("inf"), float("-inf"))):
        return {"__float__": repr(v)}
    return v


def _dec(v):
    if isinstance(v, dict):
        if "__nd__" in v:
            return np.array(v["__nd__"])
        if "__dict__" in v:
            return {_dec(k): _dec(x) for k, x in v["__dict__"]}
        if "__tuple__" in v:
            return tuple(_dec(x) for x in v["__tuple__"])
        if "__float__" in v:
            return float(v["__float__"])
    if isinstance(v, list):
        return [_dec(x) for x in v]
    return v


def save_model(model, path: str, spark: SparkSession) -> str:
    meta = {"class": f"{type(model).__module__}.{type(model).__qualname__}", "fields": {}, "frames": [],
            "submodels": [], "ml": []}
    for f in dataclasses.fields(model):
        v = getattr(model, f.name)
        if isinstance(v, DataFrame):
            v.write.mode("overwrite").parquet(f"{path}/{f.name}")
            meta["frames"].append(f.name)
        elif dataclasses.is_dataclass(v):
            save_model(v, f"{path}/{f.name}", spark)
            meta["submodels"].append(f.name)
        elif isinstance(v, list) and v and hasattr(v[0], "write") and hasattr(v[0], "transform"):
            for i, m in enumerate(v):
                m.write().overwrite().save(f"{path}/{f.name}/{i}")
            meta["ml"].append([f.name, type(v[0]).__module__, type(v[0]).__qualname__, len(v)])
        elif isinstance(v, dict) and v and all(dataclasses.is_dataclass(x) for x in v.values()):
            keys = list(v)
            for i, k in enumerate(keys):
                save_model(v[k], f"{path}/{f.name}/{i}", spark)
            meta["fields"][f.name] = {"__models__": [_enc(k) for k in keys]}
        else:
            meta["fields"][f.name] = _enc(v)
    spark.createDataFrame([(json.dumps(meta),)], "meta string").coalesce(1) \
        .write.mode("overwrite").parquet(f"{path}/_meta")
    return path


def load_model(path: str, spark: SparkSession):
    meta = json.loads(spark.read.parquet(f"{path}/_meta").first()["meta"])
    mod, _, name = meta["class"].rpartition(".")
    cls = getattr(importlib.import_module(mod), name)
    kw = {}
    for k, v in meta["fields"].items():
        if isinstance(v, dict) and "__models__" in v:
            kw[k] = {_dec(key): load_model(f"{path}/{k}/{i}", spark) for i, key in enumerate(v["__models__"])}
        else:
            kw[k] = _dec(v)
    for k in meta["frames"]:
        kw[k] = spark.read.parquet(f"{path}/{k}")
    for k in meta["submodels"]:
        kw[k] = load_model(f"{path}/{k}", spark)
    for k, m_mod, m_name, n in meta["ml"]:
        mcls = getattr(importlib.import_module(m_mod), m_name)
        kw[k] = [mcls.load(f"{path}/{k}/{i}") for i in range(n)]
    fields = {f.name for f in dataclasses.fields(cls)}
    return cls(**{k: v for k, v in kw.items() if k in fields})


def save_cox(model: CoxModel, path: str, spark: SparkSession) -> str:
    return save_model(model, path, spark)


def load_cox(path: str, spark: SparkSession) -> CoxModel:
    return load_model(path, spark)
