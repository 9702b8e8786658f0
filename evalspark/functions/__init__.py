"""Column builders: everything here returns a ``Column`` (or a plan-time constant)."""

from evalspark.functions.text import (  # noqa: F401
    PY_WHITESPACE,
    chat_messages,
    crop_middle,
    render_prompt,
    template_fields,
    validate_prompt_fields,
    word_count,
    words,
)
from evalspark.functions.parse import (  # noqa: F401
    DEFAULT_MAPPING,
    label_name,
    map_values,
    parse_cot_label,
    parse_json_label,
    parse_label,
)
