"""Format and size of images from their leading bytes, without decoding a pixel."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpuslens.functions.text import let

SEGMENTS = 2000  # of a JPEG file before its frame header, each up to 64 KB; with more, no size is given
HEADER = "struct<format:string,width:bigint,height:bigint>"


def _number(content: Column, start: Column, size: int, little: bool = False) -> Column:
    """Unsigned number of ``size`` bytes at ``start`` (from 0); null when there are fewer."""
    places = range(size, 0, -1) if little else range(1, size + 1)
    digits = F.concat(*(F.hex(F.substr(content, start + i, F.lit(1))) for i in places))
    return F.when(F.length(digits) == 2 * size, F.conv(digits, 16, 10).cast("bigint"))


def _starts(content: Column, digits: str, at: int = 0) -> Column:
    return F.substring(content, at + 1, len(digits) // 2) == F.unhex(F.lit(digits))


def _jpeg_frame(content: Column) -> Column:
    """Place of the frame header's marker: segments are walked by their lengths. Fill bytes before a
    marker are passed over, markers without a segment too; null when the walk does not reach one."""
    steps = F.sequence(F.lit(1), F.least(F.lit(SEGMENTS), F.length(content)))

    def step(state: Column, _: Column) -> Column:
        def at(marker: Column) -> Column:
            place = state["at"]
            frame = marker.between(0xC0, 0xCF) & ~marker.isin(0xC4, 0xC8, 0xCC)
            alone = (marker == 0x01) | marker.between(0xD0, 0xD8)
            skip = (
                F.when(marker == 0xFF, 1)
                .when(alone, 2)
                .otherwise(2 + _number(content, place + 2, 2))
            )
            lost = (_number(content, place, 1) != 0xFF) | marker.isNull() | marker.isin(0xD9, 0xDA)
            return F.struct(
                F.when(frame | lost, place).otherwise(place + skip).cast("int").alias("at"),
                F.when(lost, "lost").when(frame, "found").otherwise("on").alias("now"),
            )

        return F.when(state["now"] == "on", let(_number(content, state["at"] + 1, 1), at)).otherwise(state)

    start = F.struct(F.lit(2).alias("at"), F.lit("on").alias("now"))
    return F.aggregate(steps, start, step, lambda s: F.when(s["now"] == "found", s["at"]))


def image_header(content: Column) -> Column:
    """``struct<format, width, height>`` of PNG, GIF, BMP, JPEG, WebP and icon files (an icon's first
    picture); null for other content, null sizes where the file ends too early."""

    def here(start: int, size: int, little: bool = True) -> Column:
        return _number(content, F.lit(start), size, little)

    def of(name: str, width: Column, height: Column) -> Column:
        return F.struct(
            F.lit(name).alias("format"), width.cast("bigint").alias("width"), height.cast("bigint").alias("height")
        ).cast(HEADER)

    def signed(value: Column) -> Column:
        return F.when(value >= 2**31, 2**32 - value).otherwise(value)

    def low(value: Column, bits: int) -> Column:
        return value.bitwiseAND(2**bits - 1)

    core = here(14, 4) == 12
    bmp = of("bmp", F.when(core, here(18, 2)).otherwise(here(18, 4)), F.when(core, here(20, 2)).otherwise(signed(here(22, 4))))
    lossless = here(21, 4)
    webp = (
        F.when(_starts(content, "56503858", 12), of("webp", here(24, 3) + 1, here(27, 3) + 1))
        .when(_starts(content, "5650384C", 12), of("webp", low(lossless, 14) + 1, low(F.shiftright(lossless, 14), 14) + 1))
        .when(_starts(content, "56503820", 12), of("webp", low(here(26, 2), 14), low(here(28, 2), 14)))
    )

    def edge(value: Column) -> Column:
        return F.when(value == 0, 256).otherwise(value)

    def jpeg(frame: Column) -> Column:
        return of("jpeg", _number(content, frame + 7, 2), _number(content, frame + 5, 2))

    return (
        F.when(_starts(content, "89504E470D0A1A0A"), of("png", here(16, 4, False), here(20, 4, False)))
        .when(_starts(content, "FFD8FF"), let(_jpeg_frame(content), jpeg))
        .when(_starts(content, "474946383761") | _starts(content, "474946383961"), of("gif", here(6, 2), here(8, 2)))
        .when(_starts(content, "52494646") & _starts(content, "57454250", 8), webp)
        .when(_starts(content, "424D"), bmp)
        .when(_starts(content, "00000100"), of("ico", edge(here(6, 1)), edge(here(7, 1))))
    )
