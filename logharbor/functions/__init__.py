"""Column expressions: masking, parsing, identity, text and time."""

from logharbor.functions.crypto import decrypt_text, encrypt_text
from logharbor.functions.ids import doc_id_a, doc_id_b, round_cents, truncate
from logharbor.functions.jsontext import is_json, json_keys, json_map, query_string_json, query_string_map
from logharbor.functions.masking import dsl_format, fingerprint, mask_dsl, mask_json, mask_truncated
from logharbor.functions.parsing import (
    bracket_fields,
    extract_source,
    lenient_double,
    lenient_long,
    line_header,
    usage_percentages,
)
from logharbor.functions.times import (
    display_time,
    epoch_millis,
    iso_millis,
    parse_duration,
    parse_event_time,
    render_time,
)

__all__ = [
    "bracket_fields", "decrypt_text", "display_time", "doc_id_a", "doc_id_b", "dsl_format",
    "encrypt_text", "epoch_millis", "extract_source", "fingerprint", "is_json", "iso_millis",
    "json_keys", "json_map", "lenient_double", "lenient_long", "line_header", "mask_dsl",
    "mask_json", "mask_truncated", "parse_duration", "parse_event_time", "query_string_json",
    "query_string_map", "render_time", "round_cents", "truncate", "usage_percentages",
]
