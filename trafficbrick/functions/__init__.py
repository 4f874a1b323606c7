from . import addr, hashing, timefmt  # noqa: F401
from .addr import flow_label, high16, ip_from_string, ip_to_string, low16, mac_to_string, octet, prefix17  # noqa: F401
from .hashing import hash17, hash_bin, sub_bucket  # noqa: F401
from .timefmt import delta_ms, duration_string, format_count  # noqa: F401
