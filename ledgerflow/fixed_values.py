"""Fixed values.

Ids, names, labels and limits that decide the content of results. They are
data, not logic: a different value gives a different answer.
"""

# Protocol ids. The first is tested as a prefix of the package id, the second
# as a part of it; the two profiles that use them differ on purpose.
PREFIX_PROTOCOL_IDS = (
    "0xa99b8952d4f7d947ea77fe0ecdcc9e5fc0bcab2841d6e2a5aa00c3044e5544b5",
)
CONTAINED_PROTOCOL_ID = "81c408448d0d57b3e371ea94de1d40bf852784d3e225de1e74acab3e8395c18f"
LENDING_PACKAGE_ID = "0x81c408448d0d57b3e371ea94de1d40bf852784d3e225de1e74acab3e8395c18f"
LENDING_TYPE_ADDRESS = "0xd899cf7d2b5db716bd2cf55599fb0d5ee38a3061e7b6bb6eebf73fa5bc4c81ca"

# Module and event names of the lending protocol.
LENDING_MODULE = "lending"
DEPOSIT_EVENT = "DepositEvent"
WITHDRAW_EVENT = "WithdrawEvent"
BORROW_EVENT = "BorrowEvent"
REPAY_EVENT = "RepayEvent"
LIQUIDATION_EVENT = "LiquidationEvent"

# Exact event name to action label.
ACTION_BY_EVENT = {
    DEPOSIT_EVENT: "deposit",
    WITHDRAW_EVENT: "withdraw",
    BORROW_EVENT: "borrow",
    REPAY_EVENT: "repay",
}
UNKNOWN_ACTION = "unknown"

# Part of an event name to event class; the first hit wins.
CLASS_BY_NAME_PART = (
    (DEPOSIT_EVENT, "deposit"),
    (BORROW_EVENT, "borrow"),
    (WITHDRAW_EVENT, "withdraw"),
    (REPAY_EVENT, "repay"),
    (LIQUIDATION_EVENT, "liquidation"),
)
OTHER_CLASS = "other"

# Labels written into results.
PROTOCOL_LABEL = "navi"
PROTOCOL_TAGS = ("navi", "lending")
EXTRA_TAGS = ("defi", "navi-protocol")
DEFAULT_PROFILE_TAGS = ("navi", "defi")
DEFI_PROFILE_TAGS = ("navi", "defi", "lending")
DEFI_PROFILE_OTHER_TAGS = ("blockchain",)
SIMPLE_PROFILE_TAGS = ("simple",)
MATCHED_PROTOCOL_LABEL = "navi_protocol"

# Largest epoch millisecond that still is a calendar time (end of year 262142).
MAX_EPOCH_MS = 8210266876799999

# Default page size and poll interval.
PAGE_SIZE = 50
POLL_INTERVAL = "10 seconds"
