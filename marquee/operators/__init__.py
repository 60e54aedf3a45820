"""Reusable DataFrame operators: filters, top-k, members, profiles."""

from marquee.operators.filters import (  # noqa: F401
    episode_filter,
    member_filter,
    non_null_keys,
    series_filter,
    title_condition,
    title_filter,
)
from marquee.operators.members import default_members, distinct_members  # noqa: F401
from marquee.operators.profile import (  # noqa: F401
    dataset_summary,
    file_sizes,
    null_profile,
    null_profile_of,
    open_tables,
    table_profile,
    table_sample,
)
from marquee.operators.topk import top_k, top_k_per_group  # noqa: F401
