"""recon."""
