"""Writers: the store, exports, reports."""
