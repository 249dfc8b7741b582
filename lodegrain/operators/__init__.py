"""The decoders and their operators, in one namespace."""

from .collections import list_, map_
from .core import Decoder, Rule, Verdict, check, combine, discriminate, enum_of, fail, lazy, literal, nested, nullable, ok, one_of, optional_field, optional_nullable_field, recover, strict, with_default
from .core import field_ as field
from .dataset import Decoded, all_or_nothing, combined, decode, decode_column, indexed, map2, map3, map4, regroup, traverse
from .scalars import allow_blank_string, bool_, bytes_, date_, date_time, decimal_, double_, float_, from_, int_, iso8601, long_, offset_date_time, string, time_

__all__ = [
    "Decoded", "Decoder", "Rule", "Verdict", "all_or_nothing", "allow_blank_string", "bool_", "bytes_", "check", "combine", "combined", "date_", "date_time",
    "decimal_", "decode", "decode_column", "discriminate", "double_", "enum_of", "fail", "field", "float_", "from_", "indexed", "int_", "iso8601", "lazy",
    "list_", "literal", "long_", "map2", "map3", "map4", "map_", "nested", "nullable", "offset_date_time", "ok", "one_of", "optional_field",
    "optional_nullable_field", "recover", "regroup", "strict", "string", "time_", "traverse", "with_default",
]
