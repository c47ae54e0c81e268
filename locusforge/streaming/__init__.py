"""Optional streaming intake of arriving study files."""
