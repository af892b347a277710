"""What one edit does to one slot. Used where the order of mixed edits decides."""

from __future__ import annotations

# Statuses an edit can end with.
SAVED = "saved"
DAY_FULL = "day full"
DELETED = "deleted"
NOTHING = "nothing to delete"

# People who can hold a slot.
SEATS = 2


class Slot:
    """Entries of a slot: user -> [[id or None, seq that made it or None, hours], ...].

    A user's list is in id order; it is longer than one only when the snapshot holds
    duplicates. Edits see the first. In a slot that starts over-full deletes work as ever;
    sets are refused until deletes have brought it down.
    """

    def __init__(self, rows=()):
        self.held: dict[int, list[list]] = {}
        for user, entry in rows:
            self.held.setdefault(user, []).append(list(entry))

    def seed(self, user: int, entry_id: int, hours: int) -> None:
        self.held.setdefault(user, []).append([entry_id, None, hours])

    def apply(self, op: str, user: int, hour: int, seq: int) -> str:
        own = self.held.get(user)
        if op == "delete":
            if own and hour <= own[0][2]:
                own.pop(0)
                if not own:
                    del self.held[user]
                return DELETED
            return NOTHING
        if len(self.held) - (1 if own else 0) >= SEATS:
            return DAY_FULL
        if own:
            own[0][2] = hour
        else:
            self.held[user] = [[None, seq, hour]]
        return SAVED

    def rows(self):
        for user, entries in self.held.items():
            for entry_id, born, hours in entries:
                yield user, entry_id, born, hours
