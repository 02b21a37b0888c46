"""Training-data operators over corpora of documents and web pages.

Nothing else in the library imports this subpackage; it can be left out of a deployment.
"""
