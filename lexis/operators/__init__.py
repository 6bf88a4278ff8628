"""Set-oriented search, assembly and rendering."""
