"""Small inputs for what the driver's tables do not hold: opposing choices, commit messages, an event log."""

PAIRS = [
    ("p", 1, 1, "Use Postgres over Mongo for the ledger", "it joins"),
    ("p", 2, 2, "Pick tabs vs spaces in every module", "taste"),
    ("p", 3, 3, "Run batch instead of streaming for nightly reports", "cheap"),
    ("p", 4, 4, "Keep monolith rather than services this year", "small team"),
    ("p", 5, 5, "Cache results not queries in front of search", "hits"),
    ("p", 101, 101, "Use Mongo over Postgres for the new ledger", "it scales"),
    ("p", 102, 102, "Pick spaces vs tabs in every module", "taste"),
    ("p", 103, 103, "Run streaming instead of batch for hourly reports", "fresh"),
    ("p", 104, 104, "Keep services rather than monolith next year", "growth"),
    ("p", 105, 105, "Cache queries in front of search not results", "plans"),
    ("p", 106, 106, "Use Postgres over MySQL for billing data", "same side"),
    ("p", 107, 107, "Too short", "x"),
    ("p", 108, 108, "  use postgres over mongo for the ledger ", "exact"),
    ("p", 109, 109, "Write all dates in one fixed format", ""),
    ("q", 110, 110, "Use Mongo over Postgres for the ledger", "other project"),
    ("q", 111, 111, "", "nothing"),
]

COMMITS = [
    (1, "feat(api): switched to cursor pages instead of offsets\n\nOffsets were slow because deep pages rescan rows."),
    (2, "chore: tidy imports in all the old modules"),
    (3, "Merge branch 'main' into topic branch today"),
    (4, "bump to 1.2.3"),
    (5, "small tweak"),
    (6, "feat: add a button to the settings page"),
    (7, "Rework the scheduler loop for idle workers\n\nMoves over_count into chosen_id fields only."),
    (8, "fix: chose retries"),
    (9, "perf: adopted arena allocation for parse trees"),
    (10, "refactor!: adopted arena allocation because frees dominated the profile"),
    (11, "We decided to drop the old queue entirely\r\n\r\nIt lost messages on restart, which nobody noticed.\r\n"),
    (12, "feat: replaced polling with push for status pages\n\nshort why"),
    (13, ""),
    (14, "release notes were moved to the wiki pages"),
]

EVENTS = [
    ("a", 1, "insert", "first", None, False),
    ("b", 2, "insert", "second", "a", False),
    ("a", 3, "archive", "first", None, True),
    ("c", 4, "insert", "third", "b", False),
    ("a", 5, "reinforce", "first", None, False),
    ("d", 6, "insert", "fourth", "e", False),
    ("e", 7, "insert", "fifth", None, False),
    ("e", 8, "delete", "fifth", None, False),
    ("c", 9, "unarchive", "third", "b", False),
    ("c", 10, "archive", "third", "b", True),
]
