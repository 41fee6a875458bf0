"""The driver tables seen as logs, receipts and their lifecycle tables, and queries over them."""
