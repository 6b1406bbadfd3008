"""A component as a user keeps it in a synced folder."""


class Measure:
    def __init__(self):
        self.name = "Measure"

    def process(self, record):
        return f"{self.name}: {len(record)}"
