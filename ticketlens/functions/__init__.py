"""Column functions: text cleaning, date parsing, aging buckets."""

from ticketlens.functions.buckets import BUCKET_LABELS, aging_bucket
from ticketlens.functions.dates import (
    hours_between,
    parse_ticket_ts,
    with_date_parts,
)
from ticketlens.functions.text import (
    clean_description,
    drop_first_words,
    fold_text,
    is_noise,
    keyword_label,
    strip_greetings,
    strip_image_attrs,
    strip_image_embeds,
    strip_image_filenames,
    strip_image_words,
    strip_img_tags,
    strip_markdown_images,
    strip_smart_links,
    strip_urls,
    strip_whitespace,
    trim_lower,
    truncate_text,
)

__all__ = [
    "BUCKET_LABELS",
    "aging_bucket",
    "clean_description",
    "drop_first_words",
    "fold_text",
    "hours_between",
    "is_noise",
    "keyword_label",
    "parse_ticket_ts",
    "strip_greetings",
    "strip_image_attrs",
    "strip_image_embeds",
    "strip_image_filenames",
    "strip_image_words",
    "strip_img_tags",
    "strip_markdown_images",
    "strip_smart_links",
    "strip_urls",
    "strip_whitespace",
    "trim_lower",
    "truncate_text",
    "with_date_parts",
]
