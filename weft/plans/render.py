"""Text reports over collected small tables. The lines' forms are fixed values: other tools read them."""

from __future__ import annotations

import json
from typing import Any

import numpy as np

from weft.sources.headers import Header, quoted

BAR = 40


def sci(x: float, digits: int) -> str:
    """1.3374e0: a plain exponent."""
    if not np.isfinite(x):
        return "NaN" if np.isnan(x) else ("inf" if x > 0 else "-inf")
    mantissa, _, exponent = f"{x:.{digits}e}".partition("e")
    return f"{mantissa}e{int(exponent)}"


def sci_short(x: float) -> str:
    """The shortest digits of a float32, with a plain exponent."""
    if not np.isfinite(x):
        return sci(x, 0)
    mantissa, _, exponent = np.format_float_scientific(np.float32(x), unique=True, trim="-").partition("e")
    return f"{mantissa}e{int(exponent)}"


def plain(x: float, kind: type = np.float64) -> str:
    """The shortest digits, never an exponent."""
    if not np.isfinite(x):
        return sci(x, 0)
    return np.format_float_positional(kind(x), unique=True, trim="-")


def described(kind: str, value: Any) -> str:
    """A metadata value, long strings and arrays abbreviated."""
    if kind == "string":
        return quoted(value) if len(value) <= 60 else f"{quoted(value[:60])}... ({len(value)} chars)"
    if kind == "array":
        inner, n, kept = value
        return f"[{inner} x {n}] [{', '.join(described(t, v) for t, v in kept)}{', ...' if len(kept) < n else ''}]"
    if kind == "bool":
        return str(bool(value)).lower()
    if kind in ("f32", "f64"):
        return plain(value, np.float32 if kind == "f32" else np.float64)
    return str(value)


def _list(xs: list[int] | None) -> str:
    return "[" + ", ".join(str(int(x)) for x in xs or []) + "]"


def inspect(path: str, h: Header) -> str:
    out = [f"File: {path}"]
    if h.format == "safetensors":
        out += ["Format: safetensors", f"Header: {h.header_len} bytes; tensor data begins at byte {h.data_start}"]
        out.append("Metadata: " + json.dumps({k: v for k, _, v in h.metadata}, separators=(",", ":"), ensure_ascii=False))
    else:
        out.append(f"Format: GGUF v{h.version} (little-endian); alignment {h.alignment} bytes; tensor data begins at byte {h.data_start}")
        out.append(f"Metadata ({len(h.metadata)} entries):")
        out += [f"  {k}: {kind} = {described(kind, v)}" for k, kind, v in h.metadata]
    totals: dict[str, list[int]] = {}
    for t in h.tensors:
        kind = f"dtype={t.type_name} shape={_list(t.shape)}" if t.dims is None else f"type={t.type_name} dims={_list(t.dims)} shape={_list(t.shape)}"
        out.append(f"{quoted(t.name)}: {kind} data_offset={t.data_offset} file_offset={t.file_offset} size={t.byte_len} bytes elements={t.elements}")
        own = totals.setdefault(t.type_name, [0, 0])
        own[0], own[1] = own[0] + 1, own[1] + t.elements
    out.append(f"Tensors: {len(h.tensors)}")
    if totals:
        out.append("Types: " + ", ".join(f"{k} x{n} ({e} elements)" for k, (n, e) in sorted(totals.items())))
    out.append(f"Total parameters (stored tensor elements): {sum(t.elements for t in h.tensors)}")
    return "\n".join(out) + "\n"


def stats(rows: list, total: Any) -> str:
    """rows: summaries in tensor order; total: the summary of all, or None where nothing is decoded."""
    width = max([16, *(len(r["name"].encode()) + 2 for r in rows)])

    def line(name: str, dtype: str, s: Any) -> str:
        low, high = (sci(s["min"], 4), sci(s["max"], 4)) if s["finite"] else ("-", "-")
        return f"{name:<{width}} {dtype:>6} {s['count']:>11} {sci(s['mean'], 4):>11} {sci(s['std'], 4):>11} {low:>11} {high:>11} {s['zero_fraction'] * 100:>6.2f}% {s['nan']:>5} {s['inf']:>5}"

    out = [f"{'tensor':<{width}} {'dtype':>6} {'elements':>11} {'mean':>11} {'std':>11} {'min':>11} {'max':>11} {'zeros':>7} {'nan':>5} {'inf':>5}"]
    for r in rows:
        out.append(line(quoted(r["name"]), r["type_name"], r) if r["dtype"] else f"{quoted(r['name']):<{width}} {r['type_name']:>6} {r['elements']:>11}  not decoded")
    none = {"count": 0, "finite": 0, "mean": 0.0, "std": 0.0, "zero_fraction": 0.0, "nan": 0, "inf": 0}
    return "\n".join([*out, line("(all decoded)", "", total or none)]) + "\n"


def histogram(bins: list, width: int = BAR) -> str:
    """bins: low, high, count in order."""
    peak = max([1, *(b["count"] for b in bins)])
    out = []
    for k, b in enumerate(bins):
        bar = "#" * -(-b["count"] * width // peak)
        out.append(f"  [{sci(b['low'], 4):>11}, {sci(b['high'], 4):>11}{']' if k + 1 == len(bins) else ')'} {bar:<{width}} {b['count']}")
    return "\n".join(out) + "\n"


def percent(x: float) -> str:
    return f"{x * 100:.1f}%"


def message(f: Any, t: Any) -> str:
    """The sentence of a finding (a row of health.check)."""
    kind = f["check"]
    if kind == "non-finite":
        return f"{f['nan']} NaN and {f['inf']} infinite values (none allowed)"
    if kind == "all-zero":
        return f"all {f['count']} values are zero (never set?)"
    if kind == "constant":
        return f"all {f['count']} values equal {plain(f['min'], np.float32)} (one value throughout)"
    if kind == "sparse":
        return f"{percent(f['zero_fraction'])} of values are exactly zero (WARN above {percent(t.max_zero_fraction)})"
    if kind == "large-magnitude":
        return f"max |x| = {sci_short(f['abs_max'])} exceeds {sci_short(t.max_abs)}"
    if kind == "f16-range":
        return f"max |x| = {sci_short(f['abs_max'])} exceeds the F16 maximum 65504; casting to F16 would overflow"
    n = f["n_rows_seen"]
    if kind == "dead-rows":
        more = f", ... {f['n_dead'] - 5} more" if f["n_dead"] > 5 else ""
        rows = ", ".join(str(x["row"]) for x in f["dead_rows"]) + more
        return f"{f['n_dead']} of {n} rows are all zero ({percent(f['n_dead'] / n)}; WARN above {percent(t.max_dead_row_fraction)}): rows {rows}"
    rows = ", ".join(f"{x['row']} (x{x['ratio']:.3f})" for x in f["out_rows"]) + (", ..." if f["n_out"] > 5 else "")
    r = plain(t.row_norm_ratio)
    return f"{f['n_out']} of {n} rows have an L2 norm outside [median/{r}, median*{r}] (median {sci(f['median'], 4)}): rows {rows}"


def health(found: list, skipped: list, checked: int, t: Any) -> str:
    out = [f"Thresholds: max-abs={sci_short(t.max_abs)} max-zero-fraction={plain(t.max_zero_fraction)} max-dead-row-fraction={plain(t.max_dead_row_fraction)} row-norm-ratio={plain(t.row_norm_ratio)}"]
    out.append("Rows are indices along the first axis of the row-major (PyTorch-order) shape.")
    out += [f"{f['severity']:<5} {quoted(f['name'])} [{f['check']}] {message(f, t)}" for f in found]
    out += [f"SKIP  {quoted(s['name'])} [not-decoded] dtype {s['type_name']} is not decoded" for s in skipped]
    many = {s: sum(f["severity"] == s for f in found) for s in ("ERROR", "WARN", "INFO")}
    out.append(f"Checked {checked} tensors, skipped {len(skipped)}: {many['ERROR']} errors, {many['WARN']} warnings, {many['INFO']} info")
    return "\n".join(out) + "\n"


def _cosine(m: Any) -> str:
    return "-" if m["cosine"] is None else f"{m['cosine']:.6f}"


def diff(rows: list, overall: Any, top: int = 20) -> str:
    """rows: diff.compare(), collected; overall: diff.overall(), or None."""
    kinds = {k: sorted((r for r in rows if r["outcome"] == k), key=lambda r: (r["a_tensor_pos"] is None, r["a_tensor_pos"] or 0, r["b_tensor_pos"] or 0)) for k in ("compared", "shape_mismatch", "not_decoded", "only_a", "only_b")}
    n = {k: len(v) for k, v in kinds.items()}
    out = [f"Matched by name: {n['compared'] + n['shape_mismatch'] + n['not_decoded']}; compared: {n['compared']}; shape mismatches: {n['shape_mismatch']}; not decoded: {n['not_decoded']}; only in A: {n['only_a']}; only in B: {n['only_b']}"]
    out += [f"Only in A: {quoted(r['a_name'])}" for r in kinds["only_a"]] + [f"Only in B: {quoted(r['b_name'])}" for r in kinds["only_b"]]
    out += [f"Shape mismatch: {quoted(r['norm'])}: {_list(r['a_shape'])} vs {_list(r['b_shape'])}" for r in kinds["shape_mismatch"]]
    out += [f"Not decoded: {quoted(r['norm'])}: {r['a_type_name']} vs {r['b_type_name']}" for r in kinds["not_decoded"]]
    changed = sorted((r for r in kinds["compared"] if not r["identical"]), key=lambda r: (np.isnan(r["rel_l2"]) * -1, -r["rel_l2"], r["norm"].encode()))
    out.append(f"Identical: {n['compared'] - len(changed)}; changed: {len(changed)}")
    if changed:
        shown = changed[:top] if top else changed
        width = max([6, *(len(r["norm"].encode()) + 2 for r in shown)])
        out += ["", f"Changed tensors, largest relative L2 change first (showing {len(shown)} of {len(changed)}):"]
        out.append(f"{'tensor':<{width}} {'types':>11} {'elements':>10} {'changed':>8} {'max|d|':>10} {'rmse':>10} {'rel_l2':>10} {'cosine':>10}")
        for r in shown:
            types = r["a_type_name"] if r["a_type_name"] == r["b_type_name"] else f"{r['a_type_name']}>{r['b_type_name']}"
            out.append(f"{quoted(r['norm']):<{width}} {types:>11} {r['elements']:>10} {r['changed_fraction'] * 100:>7.2f}% {sci(r['max_abs_diff'], 3):>10} {sci(r['rmse'], 3):>10} {sci(r['rel_l2'], 3):>10} {_cosine(r):>10}")
            if r["nonfinite_mismatch"]:
                out.append(f"  ^ {r['nonfinite_mismatch']} positions are NaN/Inf on one side only")
    if n["compared"]:
        out += ["", f"Overall ({overall['elements']} compared elements): changed {overall['changed_fraction'] * 100:.2f}%, rel_l2 {sci(overall['rel_l2'], 3)}, cosine {_cosine(overall)}"]
    return "\n".join(out) + "\n"
