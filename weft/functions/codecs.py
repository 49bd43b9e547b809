"""The five decodable encodings: numpy codecs for payloads, Column forms for tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements and bytes of a block.
BLOCKS = {"F32": (1, 4), "F16": (1, 2), "BF16": (1, 2), "Q8_0": (32, 34), "Q4_0": (32, 18)}
_Q8 = np.dtype([("d", "<f2"), ("q", "i1", 32)])
_Q4 = np.dtype([("d", "<f2"), ("q", "u1", 16)])


def byte_range(dtype: str, start: int, n: int) -> tuple[int, int]:
    """Offset and length of elements start..start+n, both at block boundaries."""
    per, size = BLOCKS[dtype]
    if start % per or n % per:
        raise ValueError(f"{dtype}: elements {start}+{n} are not whole blocks of {per}")
    return start // per * size, n // per * size


def decode(dtype: str, data: bytes | np.ndarray) -> np.ndarray:
    """Float32 values of whole blocks."""
    with np.errstate(invalid="ignore", over="ignore"):
        if dtype == "F32":
            return np.frombuffer(data, "<f4")
        if dtype == "F16":
            return np.frombuffer(data, "<f2").astype(np.float32)
        if dtype == "BF16":
            return (np.frombuffer(data, "<u2").astype(np.uint32) << 16).view(np.float32)
        if dtype == "Q8_0":
            b = np.frombuffer(data, _Q8)
            return (b["q"].astype(np.float32) * b["d"].astype(np.float32)[:, None]).reshape(-1)
        if dtype == "Q4_0":
            b = np.frombuffer(data, _Q4)
            codes = np.concatenate([b["q"] & 15, b["q"] >> 4], axis=1).astype(np.float32) - 8
            return (codes * b["d"].astype(np.float32)[:, None]).reshape(-1)
    raise ValueError(f"{dtype} is not decoded")


def to_bf16(x: np.ndarray) -> np.ndarray:
    """Bits of the nearest bfloat16 (ties to even), NaN kept quiet."""
    bits = np.ascontiguousarray(x, "<f4").view(np.uint32)
    near = (bits + 0x7FFF + ((bits >> 16) & 1)) >> 16
    return np.where(np.isnan(x), (bits >> 16) | 0x40, near).astype("<u2")


def _inverse(d: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return np.where(d == 0, np.float32(0), np.float32(1) / d).astype(np.float32)


def encode(dtype: str, x: np.ndarray) -> bytes:
    """Bytes of float32 values; blocks must be whole."""
    x = np.ascontiguousarray(x, np.float32).reshape(-1)
    with np.errstate(invalid="ignore", over="ignore"):
        if dtype == "F32":
            return x.astype("<f4").tobytes()
        if dtype == "F16":
            return x.astype("<f2").tobytes()
        if dtype == "BF16":
            return to_bf16(x).tobytes()
        if len(x) % 32:
            raise ValueError(f"{dtype}: {len(x)} values are not whole blocks")
        rows = x.reshape(-1, 32)
        if dtype == "Q8_0":
            out = np.zeros(len(rows), _Q8)
            d = (np.fmax.reduce(np.abs(rows), axis=1, initial=0) / np.float32(127)).astype(np.float32)
            y = rows * _inverse(d)[:, None]
            code = np.trunc(y + np.copysign(np.float32(0.5), y).astype(np.float64))
            out["d"], out["q"] = d.astype("<f2"), np.clip(np.nan_to_num(code), -128, 127).astype(np.int8)
            return out.tobytes()
        if dtype == "Q4_0":
            out = np.zeros(len(rows), _Q4)
            top = rows[np.arange(len(rows)), np.argmax(np.nan_to_num(np.abs(rows), nan=-1.0), axis=1)]
            d = (np.where(np.isnan(top), np.float32(0), top) / np.float32(-8)).astype(np.float32)
            code = np.clip(np.trunc(np.nan_to_num(rows * _inverse(d)[:, None] + np.float32(8.5))), -128, 15).astype(np.int64) & 255
            out["d"], out["q"] = d.astype("<f2"), (code[:, :16] | (code[:, 16:] << 4)).astype(np.uint8)
            return out.tobytes()
    raise ValueError(f"{dtype} is not encoded")


def f16_value(bits: Column) -> Column:
    """The float of a half-precision bit pattern, without Python."""
    bits = bits.cast("int")
    exponent, mantissa = F.shiftright(bits, 10).bitwiseAND(F.lit(31)), bits.bitwiseAND(F.lit(1023))
    sign = F.when(bits.bitwiseAND(F.lit(32768)) != 0, -1.0).otherwise(1.0)
    special = F.when(mantissa == 0, sign * F.lit(float("inf"))).otherwise(F.lit(float("nan")))
    small, normal = sign * mantissa * F.pow(F.lit(2.0), F.lit(-24)), sign * (1 + mantissa / F.lit(1024.0)) * F.pow(F.lit(2.0), exponent - 15)
    return F.when(exponent == 31, special).when(exponent == 0, small).otherwise(normal).cast("float")


def _rounded(x: Column, digits: int, least: int, most: float) -> Column:
    """A float rounded (ties to even) to so many binary digits after the first; none finer than 2^(least - digits); infinite beyond most."""
    size = F.abs(x.cast("double"))
    real = (size > 0) & (size < float("inf"))
    power = F.greatest(F.floor(F.log2(F.when(real, size).otherwise(F.lit(1.0)))), F.lit(least)).cast("double")
    step = F.pow(F.lit(2.0), power - digits)
    near = F.rint(size / step) * step
    out = F.when(near > most, F.lit(float("inf"))).otherwise(near)
    return F.when(real, F.when(x < 0, -out).otherwise(out)).otherwise(x.cast("double")).cast("float")


def f16_rounded(x: Column) -> Column:
    """The half-precision number next to a float, as a float."""
    return _rounded(x, 10, -14, 65504.0)


def bf16_rounded(x: Column) -> Column:
    """The bfloat16 next to a float, as a float."""
    return _rounded(x, 7, -126, 3.3895313892515355e38)


def _bits(x: Column, near: Column, digits: int, bias: int, top: int) -> Column:
    """The bit pattern of near, the number of the format next to x, with the sign of x also where near is zero; zero itself without its sign, NaN the quiet one."""
    size = F.abs(near.cast("double"))
    real = (size > 0) & (size < float("inf"))
    power = F.floor(F.log2(F.when(real, size).otherwise(F.lit(1.0)))).cast("double")
    small = F.round(size / F.pow(F.lit(2.0), F.lit(1.0 - bias - digits)))
    normal = (power + bias) * (1 << digits) + F.round((size / F.pow(F.lit(2.0), power) - 1) * (1 << digits))
    sign = F.when(x < 0, 1 << (digits + top.bit_length())).otherwise(0)
    out = F.when(power < 1 - bias, small).otherwise(normal)
    out = F.when(F.isnan(near), F.lit(float(top * (1 << digits) + (1 << (digits - 1))))).when(size == float("inf"), F.lit(float(top * (1 << digits)))).when(size == 0, F.lit(0.0)).otherwise(out)
    return out.cast("long") + sign


def f16_bits(x: Column) -> Column:
    """The half-precision bit pattern of a float, without Python."""
    return _bits(x, f16_rounded(x), 10, 15, 31)


def bf16_bits(x: Column) -> Column:
    """The bfloat16 bit pattern of a float, without Python."""
    return _bits(x, bf16_rounded(x), 7, 127, 255)


def bf16_value(bits: Column) -> Column:
    """The float of a bfloat16 bit pattern, without Python."""
    bits = bits.cast("int")
    exponent, mantissa = F.shiftright(bits, 7).bitwiseAND(F.lit(255)), bits.bitwiseAND(F.lit(127))
    sign = F.when(bits.bitwiseAND(F.lit(32768)) != 0, -1.0).otherwise(1.0)
    special = F.when(mantissa == 0, sign * F.lit(float("inf"))).otherwise(F.lit(float("nan")))
    small, normal = sign * mantissa * F.pow(F.lit(2.0), F.lit(-133)), sign * (1 + mantissa / F.lit(128.0)) * F.pow(F.lit(2.0), exponent - 127)
    return F.when(exponent == 255, special).when(exponent == 0, small).otherwise(normal).cast("float")
