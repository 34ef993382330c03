"""Pseudonyms for the few accounts that a report mentions."""

from __future__ import annotations

import secrets
from hashlib import blake2b

DIGITS = 10


class Pseudonymiser:
    """``acct_`` and the start of a keyed hash of the id, longer where two would be equal.

    The key is drawn anew unless one is given, so pseudonyms of two reports can't be matched.
    """

    def __init__(self, salt: str | None = None, enabled: bool = True) -> None:
        self.enabled = enabled
        self._key = (salt or secrets.token_hex(16)).encode()[:64]
        self._names: dict[str, str] = {}
        self._ids: dict[str, str] = {}

    def __call__(self, account_id: str) -> str:
        if not self.enabled:
            return account_id
        if account_id not in self._names:
            digest = blake2b(account_id.encode(), key=self._key, digest_size=16).hexdigest()
            width = DIGITS
            while (name := f"acct_{digest[:width]}") in self._ids and width < len(digest):
                width += 2
            self._names[account_id], self._ids[name] = name, account_id
        return self._names[account_id]

    def resolve(self, name: str) -> str | None:
        return self._ids.get(name) if self.enabled else name

    def __len__(self) -> int:
        return len(self._names)
