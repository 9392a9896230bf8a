"""Reading and writing: ellipse tables, images, tiles, settings."""
