"""Content labels, primitive payloads, clocks and digests."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import PRIM_WIDTHS


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def scheme(label) -> Column:
    """What stands before the first colon; '' without one."""
    return F.when(F.instr(_c(label), ":") > 0, F.substring_index(_c(label), ":", 1)).when(_c(label).isNotNull(), F.lit(""))


def value(label) -> Column:
    """What stands behind the first colon; without one the whole label."""
    at = F.instr(_c(label), ":")
    return F.when(at > 0, F.substring(_c(label), at + 1, F.lit(1 << 30))).otherwise(_c(label))


def media_type(label_value) -> Column:
    """Without parameters, trimmed, in lower case."""
    return F.lower(F.trim(F.substring_index(_c(label_value), ";", 1)))


def _unsigned(payload: Column, width: int) -> Column:
    """Little-endian bytes as a decimal; reverse() is for strings only, so the hex text is turned round."""
    digits = F.hex(payload)
    turned = F.concat(*[F.substring(digits, 2 * i + 1, 2) for i in reversed(range(width))])
    return F.conv(turned, 16, 10).cast("decimal(20,0)")


def decode_prim(payload, token) -> Column:
    """The number that a payload of exactly the token's width holds; null for other tokens, ``bytes`` and widths."""
    p, out = _c(payload), None
    for name, width in PRIM_WIDTHS.items():
        # other widths are padded for conv's sake; the test of the width discards them
        raw = _unsigned(F.substring(F.concat(p, F.lit(bytes(8))), 1, width), width)
        if name[0] == "i":
            top = F.lit(str(1 << (8 * width - 1))).cast("decimal(20,0)")
            whole = F.lit(str(1 << (8 * width))).cast("decimal(20,0)")
            raw = F.when(raw >= top, raw - whole).otherwise(raw).cast("decimal(20,0)")
        fits = (_c(token) == name) & (F.octet_length(p) == width)
        out = F.when(fits, raw) if out is None else out.when(fits, raw)
    return out


def prim_fault(payload, token) -> Column:
    """Why decode_prim gives nothing; null where it does, and for ``bytes``."""
    width = F.create_map(*[F.lit(x) for kv in PRIM_WIDTHS.items() for x in kv])[_c(token)]
    return (
        F.when(_c(token) == "bytes", F.lit(None).cast("string"))
        .when(width.isNull(), F.concat(F.lit("unknown primitive "), _c(token)))
        .when(F.octet_length(_c(payload)) != width, F.concat(_c(token), F.lit(" takes "), width.cast("string"), F.lit(" bytes, not "), F.octet_length(_c(payload)).cast("string")))
    )


def wallclock(ticks, tick_hz, epoch=None, *, strict: bool = False) -> Column:
    """Timestamp of a tick count, microseconds rounded down; exact for all 64-bit ticks and rates.

    A moment that 64 bits of microseconds do not hold (some 292,000 years from
    1970) has no timestamp and is null; with ``strict`` the job fails there.
    """
    start = F.coalesce(_c(epoch), F.lit(0)) if epoch is not None else F.lit(0)
    wide = lambda x: x.cast("decimal(38,0)")
    total, hz = wide(start) + wide(_c(ticks)), wide(_c(tick_hz))
    # seconds that no timestamp reaches, on either side of 1970: beyond them div would not fit either
    most = hz * F.lit((1 << 63) // 1_000_000 + 1)
    near = F.when((hz <= 0) | (total >= -most) & (total < most), total)
    # whole numbers only: a quotient of decimals is rounded before it could be rounded down
    rest = F.pmod(near, hz)
    seconds = F.call_function("div", near - rest, hz)
    micros = F.call_function("div", wide(rest) * F.lit(1_000_000), hz)
    whole = (wide(seconds) * F.lit(1_000_000) + wide(micros)).try_cast("bigint")
    if strict:
        known = total.isNotNull() & hz.isNotNull()
        whole = F.when(whole.isNull() & known, F.raise_error(F.lit("a moment that no timestamp holds")).cast("bigint")).otherwise(whole)
    return F.timestamp_micros(whole)


def unix_seconds(when: int | datetime) -> int:
    """Whole seconds of an aware datetime; numbers pass."""
    if isinstance(when, datetime):
        if when.tzinfo is None:
            raise ValueError("a datetime without time zone names no moment")
        return int(when.timestamp() // 1)
    return int(when)


def digest(content, algorithm: str = "sha256") -> Column:
    """``algorithm:hex`` of a binary column."""
    ways: dict[str, Callable[[Column], Column]] = {
        "md5": F.md5, "sha1": F.sha1, "sha224": lambda c: F.sha2(c, 224), "sha256": lambda c: F.sha2(c, 256), "sha384": lambda c: F.sha2(c, 384), "sha512": lambda c: F.sha2(c, 512),
    }
    if algorithm in ways:
        return F.concat(F.lit(algorithm + ":"), ways[algorithm](_c(content)))
    import hashlib

    hashlib.new(algorithm)  # fails here for unknown ones, not on executors
    @F.pandas_udf("string")
    def other(x: pd.Series) -> pd.Series:
        return x.map(lambda b: None if b is None else f"{algorithm}:{hashlib.new(algorithm, b).hexdigest()}")

    return other(_c(content))


def pad4(length) -> Column:
    return F.pmod(-_c(length), F.lit(4))


def padded(data) -> Column:
    """Zero bytes up to a multiple of four."""
    zeros = F.lit(bytes(3))
    return F.concat(_c(data), F.substring(zeros, F.lit(1), pad4(F.octet_length(_c(data))).cast("int")))


def in_range(number, kind: str) -> Column:
    """Whether a number fits u8 .. u64 or i64; null stays null."""
    low, high = (-(1 << 63), (1 << 63) - 1) if kind == "i64" else (0, (1 << int(kind[1:])) - 1)
    n = _c(number).cast("decimal(38,0)")
    return (n >= F.lit(str(low)).cast("decimal(38,0)")) & (n <= F.lit(str(high)).cast("decimal(38,0)"))


def recoverability(reason, reason_class) -> Column:
    """bytes or hole: what a known reason says, else the class given, else null; never a guess."""
    from ..schema import REASONS

    known = F.create_map(*[F.lit(x) for kv in REASONS.items() for x in kv])
    return F.coalesce(known[_c(reason)], _c(reason_class))


class ContentRegistry:
    """Handlers for media types and decoder tokens: functions from a payload Column to a Column.

    The last registration of a key wins; primitives are never handed to one.
    """

    def __init__(self) -> None:
        self._mime: dict[str, Callable[[Column], Column]] = {}
        self._dec: dict[tuple[str, str], Callable[[Column], Column]] = {}

    def register_mime(self, media: str, handler: Callable[[Column], Column]) -> None:
        media = media.strip().lower()
        if not media or ";" in media:
            raise ValueError("a media type without parameters is needed")
        self._mime[media] = handler

    def register_dec(self, decoder: str, token: str, handler: Callable[[Column], Column]) -> None:
        if not decoder or not token:
            raise ValueError("a decoder's name and a token are needed")
        self._dec[decoder, token] = handler

    def _found(self, payload, label, decoder_name=None) -> Column:
        p, s, v = _c(payload), scheme(label), value(label)
        out = F.when((s == "prim") & (v != "bytes"), F.encode(decode_prim(p, v).cast("string"), "utf-8"))
        for media, handler in self._mime.items():
            out = out.when((s == "mime") & (media_type(v) == media), F.encode(handler(p).cast("string"), "utf-8"))
        if decoder_name is not None:
            for (name, token), handler in self._dec.items():
                out = out.when((s == "dec") & (_c(decoder_name) == name) & (v == token), F.encode(handler(p).cast("string"), "utf-8"))
        # a label that asks for the bytes has them
        return out.when((s == "prim") & (v == "bytes"), p)

    def content(self, payload, label, decoder_name=None, *, strict: bool = False) -> Column:
        """What a payload is by its label, as bytes: a primitive's number or a handler's string in UTF-8, else the payload itself.

        With ``strict`` the job fails where neither the label's primitive nor a handler can say.
        """
        p = _c(payload)
        found = self._found(p, label, decoder_name)
        if not strict:
            return F.coalesce(found, p)
        why = F.concat(F.lit("no reading of "), F.coalesce(_c(label), F.lit("a payload without label")), F.coalesce(F.concat(F.lit(": "), F.when(scheme(label) == "prim", prim_fault(p, value(label)))), F.lit("")))
        return F.when(found.isNull() & p.isNotNull(), F.raise_error(why).cast("binary")).otherwise(found)

    def text(self, payload, label, decoder_name=None) -> Column:
        """String content: primitives as numbers, handlers' results, null where neither says and for bytes."""
        s, v = scheme(label), value(label)
        return F.when((s == "prim") & (v == "bytes"), F.lit(None).cast("string")).otherwise(F.decode(self._found(payload, label, decoder_name), "utf-8"))
