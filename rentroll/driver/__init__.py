"""The driver's tables seen as ledgers, bank rows and messages, and the registered queries."""
