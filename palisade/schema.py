"""Bit constants and schemas."""

# Bits of the masks.
CTI, CTI_R, TAGS = 1, 2, 4
CLEAR, GREEN, AMBER, RED = 1, 2, 4, 8
CATEGORIES = {"ATTACK": 1, "MALWARE": 2, "PHISHING": 4, "BOTNET": 8, "C2": 16, "EXPLOIT": 32, "RANSOMWARE": 64, "SPAM": 128, "SCANNER": 256, "TOR_EXIT": 512, "PROXY": 1024}
MATCH, PRIVATE, PRIVATE_SKIP, WHITELISTED, SUPPRESSED, OVERLAY, THRT = 1, 2, 4, 8, 16, 32, 64
EINVAL, ETOOLONG = -1, -2

CONTRIB = "src_ord bigint, row_ord bigint, action string, value string, type string, confidence int, category_mask int, feed string, tlp_mask int, labels array<string>, layer string"
IDENTITY = "key string, kind int, plen int, ip4_start bigint, ip4_end bigint, ip6_start string, ip6_end string, str string"
RECORD = "confidence int, confidence_r int, type_mask int, tlp_mask int, category_mask int, feeds array<string>, tags array<string>, labels array<string>"
INDICATORS = f"{IDENTITY}, {RECORD}"
OVERLAY_ROWS = "value string, action string, suppress_full boolean, confidence int, type_mask int, category_mask int, tags array<string>"
PREVALENCE = "value string, fleet_count bigint, edge_count int, source_count int"
PREVALENCE_FACTS = "reporting_edges int, epoch bigint"
FEED_STATE = "feed string, generation bigint, updated bigint, cursor bigint, stream string, batch bigint"

IDENTITY_COLUMNS = ["key", "kind", "plen", "ip4_start", "ip4_end", "ip6_start", "ip6_end", "str"]
RECORD_COLUMNS = ["confidence", "confidence_r", "type_mask", "tlp_mask", "category_mask", "feeds", "tags", "labels"]


# Error numbers.
OK, ENOENT, EFORMAT, EVERSION, ECHECKSUM, ENOMEM, EIO = 0, -3, -4, -5, -6, -7, -8
ERRORS = {OK: "ok", EINVAL: "invalid argument", ETOOLONG: "value too long", ENOENT: "no such file", EFORMAT: "bad format", EVERSION: "unsupported version", ECHECKSUM: "checksum mismatch", ENOMEM: "out of memory", EIO: "input or output error"}


class EngineError(Exception):
    """An error with the number that callers of the engine know it by."""

    def __init__(self, code: int, message: str):
        super().__init__(f"{ERRORS[code]}: {message}")
        self.code = code
