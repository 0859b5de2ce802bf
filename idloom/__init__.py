"""idloom: file-identity analytics on Spark.

The core holds relational operators over files, metadata, containment, watch
lists and crawl state, plus data-preparation operators.  ``idloom.llm`` holds
operators on training text; nothing outside it imports it.
"""

__version__ = "0.1.0"
