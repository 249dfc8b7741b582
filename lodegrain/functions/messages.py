"""Message templates of the built-in codes, and their resolution as column expressions."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# Codes and templates that clients match on.
EN = {
    "required": "is required",
    "blank": "must not be blank",
    "too_short": "must be at least {min} characters",
    "too_long": "must be at most {max} characters",
    "invalid_length": "must be exactly {expected} characters",
    "out_of_range": "must be between {min} and {max}",
    "not_multiple_of": "must be a multiple of {divisor}",
    "invalid_scale": "too many decimal places (max {maxScale})",
    "too_small": "must have at least {min} elements",
    "too_big": "must have at most {max} elements",
    "invalid_size": "must have exactly {expected} elements",
    "invalid_value": "must be {expected}",
    "missing_element": "must contain {expected}",
    "missing_elements": "must contain all of {expected} (missing: {missing})",
    "duplicate_element": "must not contain duplicates: {duplicates}",
    "not_allowed": "must be one of {allowed}",
    "invalid_format": "invalid format",
    "type_mismatch": "expected {expected}",
    "unknown_field": "unknown field",
    "one_of_failed": "no variant matched",
    "missing_field": "field is missing",
}
JA = {
    "required": "必須です",
    "blank": "空白は許可されていません",
    "too_short": "{min}文字以上で入力してください",
    "too_long": "{max}文字以内で入力してください",
    "invalid_length": "{expected}文字で入力してください",
    "out_of_range": "{min}以上{max}以下で入力してください",
    "not_multiple_of": "{divisor}の倍数で入力してください",
    "invalid_scale": "小数点以下は{maxScale}桁までです",
    "too_small": "{min}個以上の要素が必要です",
    "too_big": "{max}個以内の要素が必要です",
    "invalid_size": "{expected}個の要素が必要です",
    "invalid_value": "{expected}でなければなりません",
    "missing_element": "{expected}を含む必要があります",
    "missing_elements": "{expected}をすべて含む必要があります（不足: {missing}）",
    "duplicate_element": "重複があります: {duplicates}",
    "not_allowed": "{allowed}のいずれかで入力してください",
    "invalid_format": "形式が不正です",
    "type_mismatch": "{expected}型が必要です",
    "unknown_field": "不明なフィールドです",
    "one_of_failed": "いずれのバリアントにも一致しませんでした",
    "missing_field": "フィールドが見つかりません",
}
CODES = tuple(EN)
KEYS = ("min", "max", "expected", "divisor", "maxScale", "missing", "duplicates", "allowed")

Resolver = Callable[[Column, Column], Column]


def meta_text(meta: Column, key: str) -> Column:
    """A meta entry as messages print it: lists without quotes and with a space after commas."""
    raw = F.get_json_object(meta, f"$.{key}")
    listed = F.concat(F.lit("["), F.array_join(F.from_json(raw, "array<string>"), ", ", "null"), F.lit("]"))
    return F.when(raw.startswith("["), listed).otherwise(raw)


def interpolate(template: Column, meta: Column, keys: tuple[str, ...] = KEYS) -> Column:
    """The template with {key} replaced for every entry that meta has; others stay as written."""
    for key in keys:
        found = meta_text(meta, key)
        template = F.when(found.isNotNull(), F.replace(template, F.lit("{" + key + "}"), found)).otherwise(template)
    return template


def bundle(templates: Mapping[str, str], fallback: "Resolver | None" = None) -> Resolver:
    """A resolver from a dictionary of templates; codes that it lacks go to fallback."""

    def resolve(code: Column, meta: Column) -> Column:
        out = None
        for c, t in templates.items():
            text = interpolate(F.lit(t), meta, tuple(k for k in KEYS if "{" + k + "}" in t))
            out = F.when(code == c, text) if out is None else out.when(code == c, text)
        rest = (fallback or default)(code, meta)
        return rest if out is None else out.otherwise(rest)

    return resolve


def default(code: Column, meta: Column) -> Column:
    """English messages; a code of the user's own gives `validation failed: <code>`."""
    has = lambda k: F.get_json_object(meta, f"$.{k}").isNotNull()
    low, high = meta_text(meta, "min"), meta_text(meta, "max")
    out = F.when(
        code == "out_of_range",
        F.when(has("min") & has("max"), F.concat(F.lit("must be between "), low, F.lit(" and "), high))
        .when(has("min"), F.concat(F.lit("must be at least "), low))
        .when(has("max"), F.concat(F.lit("must be at most "), high))
        .otherwise(F.lit("out of range")),
    )
    for c, t in EN.items():
        if c != "out_of_range":
            keys = tuple(k for k in KEYS if "{" + k + "}" in t)
            text = F.lit(t)
            for k in keys:
                text = F.replace(text, F.lit("{" + k + "}"), F.coalesce(meta_text(meta, k), F.lit("null")))
            out = out.when(code == c, text)
    return out.otherwise(F.concat(F.lit("validation failed: "), code))


BUNDLES: dict[str, Resolver] = {"en": bundle(EN), "ja": bundle(JA)}


def for_locale(locale: str | None) -> Resolver:
    """The bundle of a locale such as ja or ja_JP; English where there is none, never the machine's own."""
    if locale is None:
        return default
    return BUNDLES.get(locale.replace("-", "_").split("_")[0].lower(), BUNDLES["en"])
