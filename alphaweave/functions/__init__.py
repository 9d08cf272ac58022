from .scalar import *  # noqa: F401,F403
from .stats import group_quantiles, group_rank, join_stats  # noqa: F401
